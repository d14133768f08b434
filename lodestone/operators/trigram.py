"""Keyword search by word similarity over character trigrams.

A word is a run of letters and digits, lower-cased and padded with two blanks in front and one
behind.  The score is the greatest Jaccard similarity of the query's trigram set with the set
of a contiguous stretch of the content's trigrams, as float32.

A batch of queries is answered by a scan (``search``, ``overlap``): contents stay with their task
and meet blocks of queries, so only found rows leave it.  ``TrigramIndex`` answers few queries
with rare trigrams over contents that are indexed once.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.constants import TRIGRAM_THRESHOLD
from lodestone.shared import shared_dir, stored

_WORD = re.compile(r"[^\W_]+")
QUERY_BLOCK, BLOCK_GRAMS, ROWS, CHARACTERS, CELLS = 256, 65_536, 256, 262_144, 4_000_000
LETTERS = 100  # different letters up to which trigrams are numbered by a table
COARSE, FINE = 16, 32  # parts that a content is cut into for bounds
FIRST = 16  # of so many contents one is scanned first
TOGETHER, PLACES = 32, 16_384  # contents whose coarse bounds are made at once, and trigrams of the pairs whose fine ones are


def trigrams(text: str) -> list[str]:
    """Trigrams in text order, repeated ones too."""
    out = []
    for word in _WORD.findall(text.lower()):
        padded = f"  {word} "
        out.extend(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def previous(content: list[str]) -> np.ndarray:
    """Place of the last equal trigram before each, or -1."""
    last: dict[str, int] = {}
    out = np.empty(len(content), dtype=np.int64)
    for i, t in enumerate(content):
        out[i] = last.get(t, -1)
        last[t] = i
    return out


def word_similarity(query: set[str], content: list[str], before: np.ndarray | None = None) -> float:
    """Best stretch; only those from the start to the end of a run of query trigrams can be best.

    A trigram counts in a stretch from ``s`` where its last equal lies before ``s``, so the
    distinct ones of all stretches of a block of starts are running sums.
    """
    inside = np.fromiter((t in query for t in content), dtype=bool, count=len(content))
    return _best(inside, (previous(content) if before is None else before).astype(np.int32), len(query), *_runs(inside))


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of query trigrams start, and where they have ended."""
    edge = np.zeros(len(inside) + 2, dtype=bool)
    edge[1:-1] = inside
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return turns[::2], turns[1::2]


def _best(inside: np.ndarray, before: np.ndarray, total: int, starts: np.ndarray, ends: np.ndarray) -> float:
    """The best stretch from one of ``starts`` to one of ``ends``."""
    best, rows = 0.0, max(1, CELLS // max(1, len(inside)))
    for k in range(0, len(starts), rows):
        own, first = starts[k : k + rows, None], starts[k]
        last = ends[ends > first]
        if not len(last):
            break
        new = before[None, first : last[-1]] < own
        new &= np.arange(first, last[-1])[None, :] >= own
        cuts = np.r_[0, last[:-1] - first]
        size = np.cumsum(np.add.reduceat(new, cuts, axis=1, dtype=np.int32), axis=1)
        common = np.cumsum(np.add.reduceat(new & inside[None, first : last[-1]], cuts, axis=1, dtype=np.int32), axis=1)
        best = max(best, float((common / (total + size - common)).max()))
    return float(np.float32(best))


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters or digits, as ``_WORD`` has them."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts in order as numbers, and where each text's begin, with the end of the last."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n\n\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.r_[np.full(2, 32, dtype=np.int64), points]
    letter = _letters()[points]
    points[~letter] = 32
    at = np.flatnonzero(letter[2:] | letter[1:-1])  # a trigram ends at each letter and behind each word
    code = (np.where(letter[at + 1], points[at], 32) << 42) | (points[at + 1] << 21) | points[at + 2]
    starts = np.cumsum([0, *(len(t) + 3 for t in lower)])
    return code, np.searchsorted(at, starts)


class TrigramIndex:
    """Postings of contents: which contents have a trigram, in a written table.

    A content scores at or above the threshold only if it has at least three tenths of the
    query's trigrams.  Of a query with that need of t trigrams, the t / 2 most frequent are not
    looked up: contents that have at least t - t / 2 of the others are candidates, so work follows
    the postings of rarer trigrams.  The candidates' contents are then counted and scored exactly.
    Postings of a frequent trigram are dealt out in parts of PART.
    """

    PART, TOGETHER = 65_536, 256

    def __init__(self, chunks: DataFrame) -> None:
        self.spark, self.out = chunks.sparkSession, shared_dir(chunks.sparkSession, "trigram-index")
        self.contents = stored(chunks.select(F.col("id").cast("long").alias("id"), "content"), f"{self.out}/contents")
        raw = stored(_grams(self.contents, "id", "content").select("id", F.explode("grams").alias("gram")), f"{self.out}/grams")
        counts = raw.groupBy("gram").agg(F.count("*").alias("df"))
        self.counts = stored(counts.withColumn("parts", F.ceil(F.col("df") / self.PART).cast("int")), f"{self.out}/counts")
        self.postings = raw

    def candidates(self, queries: DataFrame) -> DataFrame:
        """``query_id, id`` of the pairs that can have enough trigrams in common; every pair that has them is there."""
        asked = _grams(queries.where("query <> ''").select(F.col("query_id").cast("long").alias("query_id"), "query"), "query_id", "query")
        grams = asked.select("query_id", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(self.counts, "gram", "left")
        need = F.ceil(F.col("size") * 3 / 10)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("df").desc_nulls_last(), "gram"))
        rare = grams.withColumn("need", need).withColumn("place", place).where((F.col("place") > F.floor(F.col("need") / 2)) & F.col("df").isNotNull())
        rare = rare.select("query_id", "gram", "parts", (F.col("need") - F.floor(F.col("need") / 2)).alias("least"))
        many = self.counts.where("parts > 1").select("gram", "parts")  # at most a PARTth of all postings
        dealt = self.postings.join(F.broadcast(many) if many.count() < 10_000 else many, "gram", "left")
        dealt = dealt.select("gram", "id", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
        wanted = rare.select("query_id", "gram", "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = wanted.join(dealt, ["gram", "part"]).groupBy("query_id", "id").agg(F.count("*").alias("n"), F.first("least").alias("least"))
        return met.where("n >= least").select("query_id", "id")

    def _pairs(self, queries: DataFrame) -> DataFrame:
        """``id, content, asked``: a content with up to TOGETHER or so of its queries, an array of (query_id, query)."""
        pairs = stored(self.candidates(queries), f"{shared_dir(self.spark, 'trigram-pairs')}/candidates")
        load = pairs.groupBy("id").agg(F.ceil(F.count("*") / self.TOGETHER).cast("int").alias("parts"))
        texts = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
        own = pairs.join(load, "id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).join(texts, "query_id")
        asked = own.groupBy("id", "part").agg(F.collect_list(F.struct("query_id", "query")).alias("asked"))
        # scoring outweighs the bytes: dealt out by number, or small inputs would be one task
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return asked.join(self.contents, "id").repartition(n, "id", "part").select("id", "content", "asked")

    def overlap(self, queries: DataFrame) -> DataFrame:
        """``query_id, id, common, query_size`` of the pairs with at least three tenths of the query's trigrams in common."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for own, _, grams, asked in _asked(batch):
                    present = set(grams)
                    for query_id, query in asked:
                        common = len(present & query)
                        if 10 * common >= 3 * len(query) and common:
                            out.append((query_id, own, common, len(query)))
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "common", "query_size"])

        return self._pairs(queries).mapInArrow(run, "query_id long, id long, common long, query_size long")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, id, score, rank``: the k best contents per query at or above the trigram threshold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: dict[int, list[float]] = {}  # the k best scores of the task's queries so far
            for batch in batches:
                out = []
                if len(least) > 100_000:
                    least.clear()
                for own, _, grams, asked in _asked(batch):
                    present, before = set(grams), None
                    for query_id, query in asked:
                        common, top = len(present & query), least.get(query_id, ())
                        bound = max(TRIGRAM_THRESHOLD, top[0] if len(top) == k else 0.0)
                        if not common or common / len(query) < bound - 1e-6:  # no stretch can do better
                            continue
                        before = previous(grams) if before is None else before
                        score = word_similarity(query, grams, before)
                        if score >= bound:
                            out.append((query_id, own, score))
                            top = least.setdefault(query_id, [])
                            (heapq.heappush if len(top) < k else heapq.heappushpop)(top, score)
                columns = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "id", "score"])

        found = self._pairs(queries).mapInArrow(run, "query_id long, id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _grams(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``grams``, the distinct trigrams of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [list(dict.fromkeys(trigrams(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.string()))], [key, "grams"])

    return rows.select(key, text).mapInArrow(run, f"{key} long, grams array<string>")


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[int, str, list[str], list[tuple[int, frozenset]]]]:
    """Id, content and trigrams of each row with its queries' trigram sets; sets of a batch are made once."""
    known: dict[int, frozenset] = {}
    for own, content, asked in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
        queries = []
        for q in asked:
            if q["query_id"] not in known:
                known[q["query_id"]] = frozenset(trigrams(q["query"]))
            queries.append((q["query_id"], known[q["query_id"]]))
        yield own, content, trigrams(content or ""), queries


class _Queries:
    """A block of queries: ids, numbers of trigrams, least scores, and which of the block's trigrams (rows) each query (column) has."""

    def __init__(self, rows: list[tuple[int, np.ndarray, float]]) -> None:
        self.ids, self.sizes = np.array([q for q, *_ in rows]), np.array([len(g) for _, g, _ in rows], dtype=np.float32)
        self.least = np.array([max(TRIGRAM_THRESHOLD, x) for *_, x in rows])
        self.grams, column = np.unique(np.concatenate([g for _, g, _ in rows]), return_inverse=True)
        self.has = np.zeros((len(self.grams), len(rows)), dtype=np.float32)
        self.has[column, np.repeat(np.arange(len(rows)), self.sizes.astype(np.int64))] = 1
        # the same with a few queries in each word, [word, row]: a lane is wide enough for the number of a query's trigrams
        self.lane = np.dtype(np.uint8 if (most := self.sizes.max()) < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
        lanes = np.zeros((len(self.grams), -(-len(rows) * self.lane.itemsize // 8) * 8 // self.lane.itemsize), dtype=self.lane)
        lanes[:, : len(rows)] = self.has
        self.words, self.rooms = np.ascontiguousarray(lanes.view(np.uint64).T), {}

    def rows_of(self, code: np.ndarray) -> np.ndarray:
        """The row of each trigram, or -1."""
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        return np.where(self.grams[at] == code, at, -1)

    def common(self, row: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Trigrams in common of ``n`` contents (rows) and the queries (columns)."""
        hit = row >= 0
        used, column = np.unique(row[hit], return_inverse=True)
        present = np.zeros((n, len(used)), dtype=np.float32)
        present[owner[hit], column] = 1
        return present @ self.has[used]

    def bounds(self, row: np.ndarray, before: np.ndarray, starts: np.ndarray, low: bool = False) -> np.ndarray:
        """For each content and query a score that no stretch exceeds; ``low``: that of the best stretch of whole parts.

        A stretch that starts in part a and ends in part b has at most the query's trigrams of
        the parts a to b, and at least the other ones of the parts between.
        """
        n, parts = len(starts) - 1, COARSE
        owner, width = np.repeat(np.arange(n), np.diff(starts)), _width(np.diff(starts), parts)
        cell, first = _cell_of(np.arange(len(row)) - starts[owner], before, width[owner], parts)
        cell = cell * n + owner  # [part, part of the last equal, content]
        every = _summed(np.bincount(cell[first], minlength=n * parts**2).astype(np.float32).reshape(parts, parts, n))[..., None]
        own = np.flatnonzero(first & (row >= 0))
        own = own[np.argsort(cell[own], kind="stable")]
        last = np.flatnonzero(np.diff(cell[own], append=-1))
        out = np.zeros((n, len(self.words) * 8 // self.lane.itemsize), dtype=np.float32)
        sizes = np.ones(out.shape[1], dtype=np.float32)
        sizes[: len(self.ids)] = self.sizes
        step = max(1, CELLS // len(own)) if len(own) else len(self.words)
        for k in range(0, len(self.words) if len(own) else 0, step):
            # a cell's sum is a difference of running sums, right in each lane even where these have run over
            words = self.words[k : k + step]
            sums = np.take(words, row[own], axis=1, out=self._room("sums", (len(words), len(own)), np.uint64), mode="clip")
            np.cumsum(sums, axis=1, out=sums)
            ends = np.take(sums, last, axis=1, out=self._room("ends", (len(words), len(last)), np.uint64), mode="clip")
            common = self._room("common", (n * parts**2, len(words)), np.uint64)
            common[:] = 0
            common[cell[own[last]]] = np.diff(ends, axis=1, prepend=np.uint64(0)).T
            common = _summed(common.reshape(parts, parts, n, -1)).view(self.lane)
            some = slice(k * 8 // self.lane.itemsize, k * 8 // self.lane.itemsize + common.shape[3])
            for b in range(parts):
                top = self._room("top", common[b, : b + 1].shape, np.float32)
                top[:] = common[b, : b + 1]
                others = (b, slice(0, b + 1)) if low else (b - 1, slice(1, b))
                if low or b > 1:
                    total = np.subtract(every[others], common[others], out=self._room("total", common[others].shape, np.float32))
                    total += sizes[some]
                    top[: len(total)] /= total
                if not low:
                    top[max(0, b - 1) :] /= sizes[some]
                np.maximum(out[:, some], top.max(axis=0), out=out[:, some])
        return out[:, : len(self.ids)]

    def _room(self, name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
        """An array of whatever was in it: pages that the system has to give anew cost more than the sums."""
        n = math.prod(shape) * np.dtype(kind).itemsize
        if len(self.rooms.get(name, ())) < n:
            self.rooms[name] = np.empty(n, dtype=np.uint8)
        return self.rooms[name][:n].view(kind).reshape(shape)


def _width(sizes, parts: int):
    """How many trigrams a part has, for contents of ``sizes`` trigrams."""
    return np.maximum(1, -(-sizes // parts))


def _cell_of(place: np.ndarray, before: np.ndarray, width, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each trigram its part and that of its last equal, from 1 (0: none), as one number; and whether it is the first of its kind in its part."""
    part, back = place // width, np.where(before >= 0, before // width + 1, 0)
    return part * parts + back, back <= part


def _summed(cells: np.ndarray) -> np.ndarray:
    """From numbers of ``_cell_of`` [part, part of the last equal, ...] the different ones of the parts a to b, as [b, a, ...], in place."""
    for a in range(1, len(cells)):
        cells[a:, a] += cells[a:, a - 1]
    for b in range(1, len(cells)):
        cells[b] += cells[b - 1]
    return cells


class _Scan:
    """The tasks' part: contents, a few at a time, against blocks of queries that are read from the shared folder."""

    def __init__(self, queries: DataFrame, least: DataFrame | None = None) -> None:
        own = queries.where("query <> '' and query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "query")
        own = own.withColumn("least", F.lit(0.0)) if least is None else own.join(least, "query_id", "left").fillna(0.0, ["least"])
        self.files = sorted(stored(own, f"{shared_dir(queries.sparkSession, 'queries')}/queries").inputFiles())

    def blocks(self) -> Iterator[_Queries]:
        from pyarrow import fs

        held, n = [], 0
        for uri in self.files:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=QUERY_BLOCK):
                    for query_id, query, least in zip(*(batch.column(c).to_pylist() for c in ("query_id", "query", "least")), strict=True):
                        grams = np.unique(coded([query])[0])
                        if len(held) == QUERY_BLOCK or held and n + len(grams) > BLOCK_GRAMS:
                            yield _Queries(held)
                            held, n = [], 0
                        if len(grams):
                            held.append((query_id, grams, least))
                            n += len(grams)
        if held:
            yield _Queries(held)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[_Queries] | None = None
        self.best: dict = {}
        for batch in batches:
            if kept is None:  # up to four blocks are kept, more are read again
                kept = [b for b, _ in zip(self.blocks(), range(5), strict=False)]
            for ids, texts in _slices(batch):
                code, starts = coded(texts)
                owner = np.repeat(np.arange(len(ids)), np.diff(starts))
                grams, number, before = _numbered(code, owner)
                before -= starts[owner]
                for block in kept if len(kept) < 5 else self.blocks():
                    yield from self.found(block, ids, starts, block.rows_of(grams)[number], owner, before)
        yield from self.last()

    def bounds(self, block: _Queries, starts: np.ndarray, row: np.ndarray, before: np.ndarray, low: bool = False) -> np.ndarray:
        """``_Queries.bounds`` of all contents, TOGETHER of them at once."""
        at = [starts[k : k + TOGETHER + 1] for k in range(0, len(starts) - 1, TOGETHER)]
        return np.concatenate([block.bounds(row[x[0] : x[-1]], before[x[0] : x[-1]], x - x[0], low) for x in at])

    def last(self) -> Iterator[pa.RecordBatch]:
        """What is left when a task's contents have been scanned."""
        return iter(())


class _Overlap(_Scan):
    schema = "query_id long, id long, common long, query_size long"

    def found(self, block: _Queries, ids: np.ndarray, starts: np.ndarray, row: np.ndarray, owner: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        common = block.common(row, owner, len(ids))
        i, j = np.nonzero((10 * common >= 3 * block.sizes) & (common > 0))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block.ids[j], ids[i], common[i, j].astype(np.int64), block.sizes[j].astype(np.int64))], ["query_id", "id", "common", "query_size"])


class _First(_Scan):
    """The k best scores of stretches of whole parts: of so many contents none scores less."""

    schema = "query_id long, score double"

    def __init__(self, queries: DataFrame, k: int) -> None:
        super().__init__(queries)
        self.k = k

    def found(self, block: _Queries, ids: np.ndarray, starts: np.ndarray, row: np.ndarray, owner: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        scores, key = self.bounds(block, starts, row, before, low=True).T, block.ids.tobytes()
        if key in self.best:
            scores = np.concatenate([self.best[key][1], scores], axis=1)
        if scores.shape[1] > self.k:
            scores = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k :]
        self.best[key] = block.ids, scores
        if len(self.best) > 400:
            yield from self.last()

    def last(self) -> Iterator[pa.RecordBatch]:
        for ids, scores in self.best.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, scores.shape[1])), pa.array(scores.ravel().astype(np.float64) - 1e-6)], ["query_id", "score"])
        self.best.clear()


class _Search(_Scan):
    """Passes on what may be among the k best: bounds of the best stretch, coarse and then fine, rule out nearly all pairs before they are scored."""

    schema = "query_id long, id long, score double"

    def __init__(self, queries: DataFrame, k: int, least: DataFrame | None = None) -> None:
        super().__init__(queries, least)
        self.k = k

    def found(self, block: _Queries, ids: np.ndarray, starts: np.ndarray, row: np.ndarray, owner: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(self.best) > 100_000:
            self.best.clear()
        bound = np.array([max(x, self._bound(q)) for q, x in zip(block.ids.tolist(), block.least.tolist(), strict=True)])
        out, most = [], self.bounds(block, starts, row, before)
        i, j = np.nonzero(most >= bound - 1e-5)
        order = np.argsort(-most[i, j], kind="stable")  # the highest first, so that the k-th best scores rise early
        i, j = i[order], j[order]
        ends = np.cumsum(np.diff(starts)[i])
        while len(i):
            n = max(1, int(np.searchsorted(ends, ends[0] + PLACES)))
            here = np.flatnonzero(most[i[:n], j[:n]] >= bound[j[:n]] - 1e-5)
            self._score(block, ids, starts, row, before, i[here], j[here], bound, out)
            i, j, ends = i[n:], j[n:], ends[n:]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "id", "score"])

    def _bound(self, query_id: int) -> float:
        top = self.best.get(query_id, ())
        return top[0][0] if len(top) == self.k else 0.0

    def _score(self, block: _Queries, ids: np.ndarray, starts: np.ndarray, row: np.ndarray, before: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray, out: list) -> None:
        """Scores the pairs of contents ``i`` and queries ``j`` that fine bounds leave."""
        n, length, parts = len(i), np.diff(starts)[i], FINE
        if not n:
            return
        firsts = np.cumsum(length) - length
        pair, width = np.repeat(np.arange(n), length), _width(length, parts)
        place = np.arange(len(pair)) - firsts[pair]
        own = place + starts[i][pair]
        row, before = row[own], before[own]
        mine = (row >= 0) & (block.has[row, j[pair]] > 0)
        cell, first = _cell_of(place, before, width[pair], parts)
        cell = cell * n + pair
        every, common = (_summed(np.bincount(cell[chosen], minlength=n * parts**2).astype(np.float32).reshape(parts, parts, n)) for chosen in (first, first & mine))
        total = np.broadcast_to(block.sizes[j], common.shape).copy()
        total[2:, :-2] += every[1:-1, 1:-1] - common[1:-1, 1:-1]
        most = common / total
        top = most.max(axis=(0, 1))
        for at in np.argsort(-top, kind="stable").tolist():
            least = bound[j[at]]
            if top[at] < least - 1e-5:
                continue
            here, ok = slice(firsts[at], firsts[at] + length[at]), most[:, :, at] >= least - 1e-5
            begin, end = ok.any(axis=0), ok.any(axis=1)
            begins, ends = _runs(mine[here])
            score = _best(mine[here], before[here], int(block.sizes[j[at]]), begins[begin[begins // width[at]]], ends[end[(ends - 1) // width[at]]])
            if score >= least:
                query_id, own_id = int(block.ids[j[at]]), int(ids[i[at]])
                best = self.best.setdefault(query_id, [])
                if len(best) < self.k or (score, -own_id) > best[0]:  # of equal scores the k smallest ids are enough
                    out.append((query_id, own_id, score))
                    (heapq.heappush if len(best) < self.k else heapq.heappushpop)(best, (score, -own_id))
                    bound[j[at]] = max(least, self._bound(query_id))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Ids and texts of up to ROWS rows that have up to CHARACTERS bytes or so, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part, held, first = [], 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > first and (at - first == ROWS or held + size > CHARACTERS):
            part.append((first, at))
            first, held = at, 0
        held += size
    for start, end in [*part, (first, batch.num_rows)] if batch.num_rows else []:
        rows = batch.slice(start, end - start)
        yield rows.column(0).to_numpy(), [t or "" for t in rows.column(1).to_pylist()]


def _numbered(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different trigrams, the number of each place's among them, and the place of the last equal trigram of the same text (-1: none)."""
    parts = [code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF]
    used = np.flatnonzero(np.bincount(parts[2]))  # all letters, as each ends a trigram
    n = len(used)
    if 0 < n <= LETTERS:  # few letters: their numbers make a table of all trigrams, no search or sort of codes
        small = np.zeros(used[-1] + 1, dtype=np.int64)
        small[used] = np.arange(n)
        key = (small[parts[0]] * n + small[parts[1]]) * n + small[parts[2]]
        seen = np.zeros(n**3, dtype=bool)
        seen[key] = True
        there = np.flatnonzero(seen)
        number = np.zeros(n**3, dtype=np.int64)
        number[there] = np.arange(len(there))
        grams, number = used[there // n**2] << 42 | used[there // n % n] << 21 | used[there % n], number[key]
    else:
        grams, number = np.unique(code, return_inverse=True)
    order = np.argsort(number.astype(np.uint16) if len(grams) < 1 << 16 else number, kind="stable")
    before = np.full(len(code), -1, dtype=np.int64)
    same = (number[order][1:] == number[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    before[order[1:][same]] = order[:-1][same]
    return grams, number, before


def _dealt(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Contents dealt out by number: scoring outweighs the bytes, and few large files would be few tasks."""
    spark = chunks.sparkSession
    n = most or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return chunks.where("id is not null").select(F.col("id").cast("long").alias("id"), "content").repartition(n)


def search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the k best contents per query at or above the trigram threshold, by scans of ``chunks``.

    The first scan is of one content in FIRST, by hash of the id, and of stretches of whole parts:
    as all others can only be better beside, its k-th best scores are limits for the second scan,
    that of all contents and stretches, and no task of that begins at the threshold.
    """
    some = _dealt(chunks.where(F.pmod(F.xxhash64("id"), F.lit(FIRST)) == 0), chunks.sparkSession.sparkContext.defaultParallelism)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    least = some.mapInArrow(_First(queries, k), _First.schema).withColumn("rank", place).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    found = _dealt(chunks).mapInArrow(_Search(queries, k, least), _Search.schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def overlap(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, id, common, query_size`` of the pairs that pass the lossless prefilter, by a scan of ``chunks``; no pair is shuffled."""
    return _dealt(chunks).mapInArrow(_Overlap(queries), _Overlap.schema)
