"""Benchmark decontamination by Wu-Manber search over words.

Symbols are words.  Windows of equal length (13 words, or a whole shorter item) share one
searcher: a table of shifts by block of up to three words skips positions at which no window
can end, buckets by the last block and first word select windows, and direct comparison
confirms.  Items go to the shared folder in blocks of bounded size; a task holds one block of
searchers at a time, and documents are scanned where they lie, without a shuffle.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import open_fs, shared_dir, table, whole_row, words_of, write_once

WINDOW = 13
#: Bytes of items' text in one block.
BLOCK_BYTES = 8_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Searcher:
    """Wu-Manber tables for windows of one length; ``windows`` maps a tuple of words to its item numbers."""

    def __init__(self, length: int, windows: dict[tuple, set[int]]) -> None:
        self.length, self.windows = length, windows
        self.block = block = min(3, length)
        self.default = length - block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[bytes, list[tuple]]] = {}
        for window in windows:
            for end in range(block, length + 1):
                key, shift = window[end - block : end], length - end
                if shift < self.shift.get(key, self.default):
                    self.shift[key] = shift
            self.bucket.setdefault(window[length - block :], {}).setdefault(window[0], []).append(window)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """Start and items of every occurrence, overlapping ones too."""
        length, block, default, shift, at, n = self.length, self.block, self.default, self.shift, self.length, len(words)
        while at <= n:
            key = tuple(words[at - block : at])
            skip = shift.get(key, default)
            if skip:
                at += skip
                continue
            start = at - length
            for window in self.bucket[key].get(words[start], ()):
                if tuple(words[start:at]) == window:
                    yield start, self.windows[window]
            at += 1


def searchers(items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[list[Searcher], list[str]]:
    """Searchers by window length and the item names their numbers stand for.  Items without words have none."""
    names: list[str] = []
    number: dict[str, int] = {}
    by_length: dict[int, dict[tuple, set[int]]] = {}
    for item_id, text in items:
        if item_id is None or not (words := words_of(text)):
            continue
        name = str(item_id)
        if name not in number:
            number[name] = len(names)
            names.append(name)
        length = min(window, len(words))
        windows = by_length.setdefault(length, {})
        for i in range(len(words) - length + 1):
            windows.setdefault(tuple(words[i : i + length]), set()).add(number[name])
    return [Searcher(k, v) for k, v in sorted(by_length.items())], names


def write_items(benchmark: DataFrame, out_dir: str, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Writes items in blocks of about ``block_bytes`` of text, one at a time, and returns their URIs."""
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    paths = []
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        items = [(r.item_id, r.text) for r in block.collect()]  # bounded: one block
        paths.append(f"{out_dir}/items-{k:05d}")
        write_once(paths[-1], lambda stream, items=items: stream.write(pickle.dumps(items)))
    return paths


_loaded: dict[str, tuple[list[Searcher], list[str]]] = {}


def _load(path: str) -> tuple[list[Searcher], list[str]]:
    if path not in _loaded:
        _loaded.clear()  # one block at a time
        system, at = open_fs(path)
        with system.open_input_stream(at) as stream:
            _loaded[path] = searchers(pickle.loads(stream.read()))
    return _loaded[path]


def scan(docs: DataFrame, benchmark: DataFrame, passthrough: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document ``SCHEMA``; with ``passthrough`` the document's own columns, as struct ``d``, and ``contaminated``.

    A null text has no words and is clean, as is an empty one.  Items with null id or without
    words never occur; rows of one item_id are one item.  Texts of any length are searched whole.
    Repeated documents give repeated rows, and items with equal windows all occur.  An empty
    benchmark leaves all clean; an empty table of documents gives no rows.  Other columns are
    ignored, whatever their names.
    """
    paths = write_items(benchmark, shared_dir(docs.sparkSession, "benchmark-items"), block_bytes)

    def judge(texts: list[str | None]) -> list[tuple]:
        words = [words_of(t) for t in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for path in paths:
            found, names = _load(path)
            for i, w in enumerate(words):
                for s in found:
                    for start, numbers in s.find(w):
                        spans[i].append((start, start + s.length))
                        items[i].update(names[k] for k in numbers)
        out = []
        for w, own, names in zip(words, spans, items, strict=True):
            hit = reach = 0
            for start, end in sorted(own):
                hit += max(0, end - max(start, reach))
                reach = max(reach, end)
            out.append((len(w), hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0 and 20 * hit >= len(w)))
        return out

    if passthrough:
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = [x[-1] for x in judge(batch.column(0).field("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bad, pa.bool_())], ["d", "contaminated"])

        schema = T.StructType([T.StructField("d", docs.schema), T.StructField("contaminated", T.BooleanType())])
        return docs.select(whole_row(docs).alias("d")).mapInArrow(mark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            columns = list(zip(*judge(batch.column(1).to_pylist()), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they had, whatever their names.

    Null and empty texts are kept, as are all of an empty benchmark; repeated rows share a verdict;
    texts are judged whole; an empty table gives no rows.
    """
    kept = scan(docs, benchmark, passthrough=True).where(~F.col("contaminated"))
    return kept.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hits AS (
  SELECT p.doc_id, p.i, p.m, win.item_id FROM (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS x FROM pos) p JOIN win ON win.m = p.m AND win.x = p.x),
words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
