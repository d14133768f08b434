"""Hard negatives by bit-sliced integer products.

Vectors become integers.  A row's components, less the least one of its block, are unsigned
numbers; their bit-planes are multiplied with the anchors one at a time, most significant
first.  After each plane the part still unknown of a score lies between two numbers that
follow from the anchor's positive and negative components, so every score has an interval;
pairs whose interval cannot qualify any more are dropped, and what is left at the last plane
is exact.

Anchors are a stated set of queries (about a hundredth of the rows), written in blocks to the
shared folder; rows are not shuffled: a task takes its rows in blocks of bounded size and reads
the anchors' blocks one after the other.  A pass over the anchors' own rows goes first: its
scores are limits that make the pass over all rows drop pairs early and return few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import open_fs, shared_dir, stored, table

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 5, 80, 100
#: Rows of a task's block, anchors of a block, and pairs below which single pairs are finished one by one.
ROWS, ANCHORS, SPARSE = 1 << 15, 512, 1 / 32
#: Components from this size on take no part: products would not fit a long with certainty.
LARGEST = 1 << 24
FAR = 1 << 62


def vectors(rows: DataFrame, relabel: bool = True) -> DataFrame:
    """``row, vec_id, label, v`` of the rows that take part: v holds the integer components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * 256) < LARGEST))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")) if relabel else F.col("label")
    own = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return own.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * 256).cast("int")).alias("v"))


def matrix(v: pa.Array) -> np.ndarray:
    """rows x components of a list column whose lists are of one length."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def best(score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller vec_id, then by place."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
        return near[np.lexsort((vec_id[near], -score[near]))[:k]]
    return np.lexsort((vec_id, -score))[:k]


class Slices:
    """A block of rows as bit-planes."""

    def __init__(self, v: np.ndarray) -> None:
        self.v = v
        self.least = int(v.min()) if v.size else 0
        u = (v.astype(np.int64) - self.least).astype(np.uint32)
        self.planes = int(u.max()).bit_length() if u.size else 0
        self.bits = [((u >> np.uint32(p)) & np.uint32(1)).astype(np.float32).T for p in range(self.planes)]  # components x rows

    def scores(self, anchors: np.ndarray, open_: np.ndarray, qualify) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and exact score of the pairs that are still open after all planes.

        ``qualify(low, high, open_)`` narrows ``open_`` (anchors x rows) by the intervals.  An anchor
        whose components are large is split in parts of 12 bits, so that products are exact in float32.
        """
        a = anchors.astype(np.int64)
        up, down = np.where(a > 0, a, 0).sum(axis=1)[:, None], np.where(a < 0, a, 0).sum(axis=1)[:, None]
        known = np.zeros(open_.shape, dtype=np.int64) + self.least * a.sum(axis=1)[:, None]
        for p in range(self.planes - 1, -1, -1):
            rest = (1 << p) - 1
            rows = np.flatnonzero(open_.any(axis=0))  # rows without an open pair are dropped whole
            if not len(rows):
                break
            if len(rows) < open_.shape[1] // 2:
                known[:, rows] += _exact(a, self.bits[p][:, rows]) << p
            else:
                known += _exact(a, self.bits[p]) << p
            open_ = qualify(known + rest * down, known + rest * up, open_)
            if p and np.count_nonzero(open_) < SPARSE * open_.size:
                i, j = np.nonzero(open_)
                return self._finish(a, i, j, known[i, j], p)
        i, j = np.nonzero(open_)
        return i, j, known[i, j]

    def _finish(self, a: np.ndarray, i: np.ndarray, j: np.ndarray, known: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lower planes of the few pairs left, together, for these pairs alone."""
        mask = np.uint32((1 << planes) - 1)
        for at in range(0, len(i), 100_000):
            part = slice(at, at + 100_000)
            low = ((self.v[j[part]].astype(np.int64) - self.least).astype(np.uint32) & mask).astype(np.int64)
            known[part] += (a[i[part]] * low).sum(axis=1)
        return i, j, known


def _exact(a: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Integer product of anchors with a plane of zeros and ones."""
    if not a.size or int(np.abs(a).max()) * a.shape[1] < 1 << 24:
        return (a.astype(np.float32) @ plane).astype(np.int64)
    return (a.astype(np.float64) @ plane.astype(np.float64)).astype(np.int64)  # below 2 ** 53 for 2 ** 29 components


def kth(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest lower bound of each anchor."""
    return np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k][:, None] if low.shape[1] >= k else np.full((len(low), 1), -FAR)


def near_same(row, label, vec_id, slices, block: dict) -> list[np.ndarray]:
    """The first POSITIVES of a block's rows for each anchor, of its label, not the anchor itself."""
    open_ = (label[None, :] == block["label"][:, None]) & (row[None, :] != block["row"][:, None])
    limit = block["limit"][:, None]

    def qualify(low, high, open_):
        least = np.maximum(limit, kth(np.where(open_, low, -FAR), POSITIVES))
        return open_ & (high >= least)

    return _firsts(*slices.scores(block["v"], open_, qualify), vec_id, lambda anchor, j, s: [best(s, vec_id[j], POSITIVES)])


def near_other(row, label, vec_id, slices, block: dict) -> list[np.ndarray]:
    """The first NEGATIVES of a block's rows for each anchor and score of a positive, of another label."""
    open_ = label[None, :] != block["label"][:, None]
    tops = block["tops"]  # anchors x POSITIVES scores, -1 where there is none
    floors = np.maximum(-(-LOW * tops // HIGH), block["limits"])

    def qualify(low, high, open_):
        fits = np.zeros(open_.shape, dtype=bool)
        for k in range(tops.shape[1]):
            top, least = tops[:, k][:, None], floors[:, k][:, None]
            least = np.maximum(least, kth(np.where(open_ & (high <= top) & (low >= least), low, -FAR), NEGATIVES))
            fits |= (top >= 0) & (high >= least) & (low <= top)
        return open_ & fits

    def choose(anchor, j, s):
        windows = (np.flatnonzero((s <= top) & (s >= least) & (top >= 0)) for top, least in zip(tops[anchor], floors[anchor], strict=True))
        return [fits[best(s[fits], vec_id[j][fits], NEGATIVES)] for fits in windows]

    return _firsts(*slices.scores(block["v"], open_, qualify), vec_id, choose)


def _firsts(i, j, score, vec_id, choose) -> list[np.ndarray]:
    """Anchor, vec_id, row place and score of what ``choose`` takes for each anchor."""
    order = np.argsort(i, kind="stable")
    i, j, score = i[order], j[order], score[order]
    cuts = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1, len(i)]
    taken = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            taken.append(a + np.unique(np.concatenate(choose(i[a], j[a:b], score[a:b]))))
    at = np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)
    return [i[at], vec_id[j[at]], j[at], score[at]]


def scan(rows: DataFrame, blocks: DataFrame, find) -> DataFrame:
    """``anchor, row, vec_id, score``: what ``find`` takes for each anchor, in each block of rows.

    ``blocks`` is the written table of anchors (with block, row, vec_id, label, v and limits); a
    task reads it block by block.  Vectors meet vectors of their own length only.
    """
    folder = sorted(blocks.inputFiles())

    def read() -> Iterator[pa.RecordBatch]:
        for uri in folder:
            system, path = open_fs(uri)
            with system.open_input_file(path) as source:
                yield from pq.ParquetFile(source).iter_batches(batch_size=ANCHORS)

    def anchors() -> Iterator[dict]:
        for part in _gathered(read(), ANCHORS):
            yield from _by_length(part)

    few = blocks.count() <= 4 * ANCHORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(anchors()) if few else None  # otherwise read again for each block of rows
        for chunk in _gathered(batches, ROWS):
            for own in _by_length(chunk):
                slices = Slices(own["v"])
                for block in kept if kept is not None else anchors():
                    if block["v"].shape[1] == own["v"].shape[1]:
                        i, ids, j, score = find(own["row"], own["label"], own["vec_id"], slices, block)
                        yield pa.RecordBatch.from_arrays([pa.array(block["row"][i]), pa.array(own["row"][j]), pa.array(ids), pa.array(score)], ["anchor", "row", "vec_id", "score"])

    return rows.select("row", "vec_id", "label", "v").mapInArrow(run, "anchor long, row long, vec_id long, score long")


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[dict]:
    """The columns of the batches in blocks of at least so many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= least:
            yield _columns(held)
            held, n = [], 0
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> dict:
    together = pa.Table.from_batches(held)
    return {c: together.column(c).combine_chunks() for c in together.column_names}


def _by_length(columns: dict) -> Iterator[dict]:
    """The columns as arrays, vectors of one length at a time."""
    v = columns["v"]
    lengths = np.asarray(v.value_lengths())
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        take = pa.array(at)
        out = {}
        for name, column in columns.items():
            part = column.take(take) if len(at) < len(lengths) else column
            out[name] = matrix(part) if pa.types.is_list(part.type) or pa.types.is_large_list(part.type) else part.to_numpy(zero_copy_only=False)
        yield out


def first_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group; an anchor's rows are at most k from each block of rows."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "row"))).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = EVERY, relabel: bool = True) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null vec_id, label, vector or component, with a component that is not finite,
    or of 65536 and more (whose integer would be 2 ** 24 and more), take no part; an empty
    vector scores 0 with other empty ones.  Only vectors of one length have a score.  Repeated
    rows are rows of their own: a copy of an anchor is another row, and a repeated anchor has its
    results again.  Ties go to the smaller vec_id; of equal vec_ids to the earlier row.  Other
    columns are ignored.  An empty table gives no rows.
    """
    out = shared_dir(embeddings.sparkSession, "hard-negatives")
    rows = stored(vectors(embeddings, relabel), f"{out}/vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    own = stored(anchors.withColumn("limit", F.lit(-FAR).cast("long")), f"{out}/anchors")
    seed = first_of(scan(own, own, near_same), ["anchor"], POSITIVES).groupBy("anchor").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    limit = F.when(F.col("n") >= POSITIVES, F.col("low")).otherwise(-FAR).cast("long")
    own = stored(anchors.join(seed.withColumnRenamed("anchor", "row"), "row", "left").select(*anchors.columns, F.coalesce(limit, F.lit(-FAR).cast("long")).alias("limit")), f"{out}/limited")
    positives = stored(first_of(scan(rows, own, near_same), ["anchor"], POSITIVES), f"{out}/positives")

    tops = positives.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("t"))
    full = F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda k: F.greatest(F.coalesce(F.get("t", k), F.lit(-1).cast("long")), F.lit(-1).cast("long")))
    ready = anchors.join(tops.withColumnRenamed("anchor", "row"), "row").withColumn("tops", full).drop("t")
    none = F.transform("tops", lambda t: F.lit(-FAR).cast("long"))
    first = stored(ready.withColumn("limits", none), f"{out}/with-tops")
    seed = _windows(scan(own, first, near_other), positives).groupBy("anchor", "place").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    seed = seed.where(F.col("n") >= NEGATIVES).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "low"))).alias("m"))
    known = F.transform(F.sequence(F.lit(1), F.lit(POSITIVES)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(-FAR).cast("long")))
    limited = stored(ready.join(seed.withColumnRenamed("anchor", "row"), "row", "left").withColumn("limits", known).drop("m"), f"{out}/with-limits")
    found = _windows(scan(rows, limited, near_other), positives)
    named = rows.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")).where(F.col("anchor_id") % every == 0)
    return found.join(named, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _windows(found: DataFrame, positives: DataFrame) -> DataFrame:
    """``found`` for each positive of its anchor whose window it is in, the first NEGATIVES of each."""
    tops = positives.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = found.join(tops, "anchor").where((LOW * F.col("positive_score") <= HIGH * F.col("score")) & (F.col("score") <= F.col("positive_score")))
    return first_of(met, ["anchor", "place"], NEGATIVES)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(256 * x::DOUBLE) >= 16777216)) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""
