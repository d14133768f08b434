"""Exact cosine search of a set of queries, by a scan or through a pivot index.

Queries are written to the shared folder once and read by tasks in blocks; vectors stay where
they are.  A task takes its vectors in blocks of ROWS, multiplies each with each block of
queries, at most PAIRS pairs at once, and passes on at most k rows a query, so only candidates
are shuffled.  ``group``
separates models: a vector's group selects the queries it is multiplied with, all in one pass.

The pivot index keeps vectors by their nearest pivot (of a sample of the vectors), with the
angle to it.  By the triangle inequality of angles, a vector at most r from a pivot that is t
from a query is at least t - r from the query.  A query first searches the cell of its nearest
pivot; its k-th score there rules out cells, whole folders of them before they are read, and
blocks within tasks for single blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import shared_dir, stored

QUERY_BLOCK, ROWS, PIVOTS = 2048, 16_384, 1024
PAIRS = 2_000_000  # scores that a task holds at once, whatever the numbers of vectors and queries
SLACK = 1e-6  # of angles near 0 and pi, where rounding of cosines shows most


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null for a zero vector or unequal widths."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length, as doubles; nan for zero vectors."""
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def _chosen(score: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row from ``least`` on, ties by smaller id."""
    if score.shape[1] > 4 * k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        least = np.maximum(least, edge)
    i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    starts = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1] if len(i) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    return i[place < k], j[place < k]


def _prepared(queries: DataFrame, dim: int, group: bool, limits: bool = False) -> DataFrame:
    """The queries as a written table, a missing group being null: that of all vectors."""
    own = queries.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))
    columns = [F.col("query_id").cast("long").alias("query_id"), (F.col("group").cast("string") if group else F.lit(None).cast("string")).alias("group"), F.col("embedding").cast("array<float>").alias("embedding")]
    columns.append((F.col("least") if limits else F.lit(-2.0)).cast("double").alias("least"))
    return stored(own.select(*columns), f"{shared_dir(queries.sparkSession, 'queries')}/queries")


class _Scan:
    """The tasks' part: blocks of vectors against blocks of queries."""

    schema = "query_id long, group string, id long, score double"

    def __init__(self, queries: DataFrame, k: int, dim: int, pivots: np.ndarray | None = None) -> None:
        self.files, self.k, self.dim, self.pivots = sorted(queries.inputFiles()), k, dim, pivots

    def blocks(self) -> Iterator[tuple]:
        """Ids, groups, unit vectors and limits of the queries, block by block."""
        from pyarrow import fs

        for uri in self.files:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as source:
                for b in pq.ParquetFile(source).iter_batches(batch_size=QUERY_BLOCK):
                    if b.num_rows:
                        unit = _unit(b.column("embedding"), self.dim)
                        angles = np.arccos(np.clip(np.nan_to_num(unit) @ self.pivots.T, -1, 1)) if self.pivots is not None else None
                        yield b.column("query_id").to_numpy(), np.array(b.column("group").to_pylist(), dtype=object), unit, b.column("least").to_numpy(), angles

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = [], 0, None
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                if kept is None:
                    kept = self._few()
                yield from self._block(pa.Table.from_batches(held).combine_chunks(), kept)
                held, n = [], 0
        if n:
            yield from self._block(pa.Table.from_batches(held).combine_chunks(), kept if kept is not None else self._few())

    def _few(self) -> list | bool:
        """The blocks, where there are at most four; they are read again otherwise."""
        out = []
        for block in self.blocks():
            if len(out) == 4:
                return False
            out.append(block)
        return out

    def _block(self, rows: pa.Table, kept) -> Iterator[pa.RecordBatch]:
        ids, groups = rows.column("id").to_numpy(), np.array(rows.column("group").to_pylist(), dtype=object)
        unit = _unit(rows.column("embedding").combine_chunks() if isinstance(rows.column("embedding"), pa.ChunkedArray) else rows.column("embedding"), self.dim)
        pivot, angle = (rows.column(c).to_numpy() for c in ("pivot", "angle")) if self.pivots is not None else (np.zeros(len(ids), dtype=np.int64), None)
        parts = {}
        for at, key in enumerate(zip(groups.tolist(), pivot.tolist(), strict=True)):
            parts.setdefault(key, []).append(at)
        for query_id, asked, q, least, angles in kept if kept is not False else self.blocks():
            for (group, cell), at in parts.items():
                at = np.array(at)
                open_ = np.array([g is None or g == group for g in asked])
                if angles is not None:  # the triangle inequality: no vector of this part can be better
                    near, far = angle[at].min(), angle[at].max()
                    gap = np.maximum(np.maximum(angles[:, cell] - far, near - angles[:, cell]), 0)
                    open_ &= np.cos(np.clip(gap - SLACK, 0, np.pi)) >= least - 1e-9
                open_, mine, step = np.flatnonzero(open_), unit[at].T, max(1, PAIRS // len(at))
                for first in range(0, len(open_), step):
                    some = open_[first : first + step]
                    score = q[some] @ mine
                    np.nan_to_num(score, copy=False, nan=-np.inf)
                    i, j = _chosen(score, ids[at], self.k, least[some] - 1e-12)
                    yield pa.RecordBatch.from_arrays([pa.array(query_id[some][i]), pa.array([group] * len(i), pa.string()), pa.array(ids[at][j]), pa.array(score[i, j])], ["query_id", "group", "id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "group").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rows(chunks: DataFrame, dim: int, group: str | None) -> DataFrame:
    own = chunks.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))
    return own.select(F.col("id").cast("long").alias("id"), (F.col(group).cast("string") if group else F.lit("")).alias("group"), F.col("embedding").cast("array<float>").alias("embedding"))


def top_k(queries: DataFrame, chunks: DataFrame, k: int, dim: int, group: str | None = None) -> DataFrame:
    """``query_id, id, score, rank`` of the k nearest chunks per query (score desc, id), by a scan.

    Rows of another width, with null components, and zero vectors have no score.  With ``group``,
    a column of ``chunks``, k are found per query and group, and the group is returned; queries
    with a column ``group`` meet the vectors of theirs only.
    """
    found = _rows(chunks, dim, group).mapInArrow(_Scan(_prepared(queries, dim, "group" in queries.columns), k, dim), _Scan.schema)
    ranked = _ranked(found, k)
    return ranked.select("query_id", *(["group"] if group else []), "id", "score", "rank")


class PivotIndex:
    """Vectors by nearest pivot, in a table partitioned by it; ``search`` gives what ``top_k`` does."""

    def __init__(self, chunks: DataFrame, dim: int, group: str | None = None, pivots: int | None = None) -> None:
        """``pivots``: by default half the root of the number of vectors, from 8 to PIVOTS."""
        self.spark, self.dim, self.group = chunks.sparkSession, dim, group
        pivots = pivots or min(PIVOTS, max(8, int(chunks.count() ** 0.5 / 2)))
        rows = _rows(chunks, dim, group).where(F.exists("embedding", lambda x: x != 0))
        sample = rows.select("embedding", F.xxhash64("id", "embedding").alias("h")).orderBy("h", "embedding").limit(pivots).select("embedding").toArrow()  # bounded
        self.pivots = _unit(sample.column(0).combine_chunks(), dim) if len(sample) else np.zeros((0, dim))
        own = self.pivots

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cos = np.clip(_unit(b.column("embedding"), dim) @ own.T, -1, 1)
                pivot = cos.argmax(axis=1) if b.num_rows else np.zeros(0, dtype=np.int64)
                angle = np.arccos(cos[np.arange(len(pivot)), pivot])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int32)), pa.array(angle)], [*b.schema.names, "pivot", "angle"])

        schema = "id long, group string, embedding array<float>, pivot int, angle double"
        path = f"{shared_dir(self.spark, 'pivot-index')}/vectors"
        # by ranges of (pivot, id): few files a pivot, and a pivot of any size is dealt out
        rows.mapInArrow(assign, schema).repartitionByRange("pivot", "id").write.partitionBy("pivot").parquet(path)
        self.table = self.spark.read.schema(schema).parquet(path)
        cells = self.table.groupBy("pivot").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count("*").alias("n")).collect()  # at most a row a pivot
        self.cells = {r.pivot: (r.near, r.far, r.n) for r in cells}

    def _with_cell(self, queries: DataFrame) -> DataFrame:
        """The queries with their nearest pivot that has vectors."""
        there = sorted(self.cells)
        pivots = self.pivots[there]
        dim = self.dim

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cos = np.nan_to_num(_unit(b.column("embedding"), dim)) @ pivots.T
                best = np.array(there, dtype=np.int32)[cos.argmax(axis=1)] if b.num_rows else np.zeros(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], [*b.schema.names, "pivot"])

        return queries.mapInArrow(nearest, ", ".join(f"{n} {t}" for n, t in queries.dtypes) + ", pivot int")

    def limits(self, queries: DataFrame, k: int) -> DataFrame:
        """The prepared queries with ``least``, the k-th score in the cell of the nearest pivot (-2 where it has fewer)."""
        own = _prepared(queries, self.dim, "group" in queries.columns)
        if not self.cells:
            return own
        if self.group and "group" not in queries.columns:  # k for each group: no one limit holds for all
            return own
        near = stored(self._with_cell(own), f"{shared_dir(self.spark, 'queries')}/nearest")
        cell = F.concat_ws("/", F.col("pivot").cast("string"), "group") if self.group else F.col("pivot").cast("string")
        rows = self.table.select("id", cell.alias("cell"), "embedding")
        first = top_k(near.select("query_id", cell.alias("group"), "embedding"), rows, k, self.dim, "cell").groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
        least = F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0)
        return own.drop("least").join(first, "query_id", "left").withColumn("least", F.coalesce(least, F.lit(-2.0))).drop("low", "n")

    def needed(self, queries: DataFrame) -> DataFrame:
        """``query_id, pivot`` of the cells that may hold one of the query's k best, for prepared queries with limits."""
        pivots, cells, dim = self.pivots, self.cells, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                angles = np.arccos(np.clip(np.nan_to_num(_unit(b.column("embedding"), dim)) @ pivots.T, -1, 1))
                least, out = b.column("least").to_numpy(), []
                for cell, (near, far, _) in cells.items():
                    gap = np.maximum(np.maximum(angles[:, cell] - far, near - angles[:, cell]), 0)
                    out += [(i, cell) for i in np.flatnonzero(np.cos(np.clip(gap - SLACK, 0, np.pi)) >= least - 1e-9)]
                i, cell = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(i)), pa.array(cell.astype(np.int32))], ["query_id", "pivot"])

        return queries.select("query_id", "embedding", "least").mapInArrow(run, "query_id long, pivot int")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        asked = stored(self.limits(queries, k), f"{shared_dir(self.spark, 'queries')}/limited")
        cells = [r.pivot for r in self.needed(asked).select("pivot").distinct().collect()] if self.cells else []  # at most a row a pivot
        rows = self.table.where(F.col("pivot").isin(cells)) if cells else self.table.limit(0)
        found = rows.mapInArrow(_Scan(asked, k, self.dim, self.pivots), _Scan.schema)
        return _ranked(found, k).select("query_id", *(["group"] if self.group else []), "id", "score", "rank")

    def pruned_share(self, queries: DataFrame, k: int) -> float:
        """Share of pairs of a query and a vector that lie in cells ruled out."""
        asked = stored(self.limits(queries, k), f"{shared_dir(self.spark, 'queries')}/limited")
        sizes = self.spark.createDataFrame([(p, c[2]) for p, c in self.cells.items()], "pivot int, n long")
        left = self.needed(asked).join(sizes, "pivot").agg(F.sum("n")).first()[0] or 0
        return 1 - left / max(1, asked.count() * sum(c[2] for c in self.cells.values()))
