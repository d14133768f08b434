"""Token-id files: one zstandard frame per document under a shared trained dictionary.

File: ``MAGIC``, dictionary SHA-256 (32 bytes), frames; then the index (doc ids, null flags,
frame offsets, token counts) and a trailer of fixed size with the index place, document count
and CRC-32 of the index.  Frames are serialised ids, little-endian unsigned 32-bit.  One
document is two range reads: the trailer with its index, and the frame.

Files are ascending in doc_id: ``documents`` is range-partitioned and sorted, each task writes
one file under a private name and moves it.  A repeated task writes equal bytes.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.llm.common import open_fs, shared_dir, stored, table, write_once

MAGIC = b"LDIDS001"
TRAILER = struct.Struct("<QQQI8s")  # index offset, index length, documents, index crc, magic
SLICES = 8
MANIFEST = "part int, path string, n_docs long, n_tokens long, dict_sha256 string"


def train_dictionary(docs: DataFrame, tokenizer: str, sample_rows: int = 400, sample_chars: int = 2000, size: int = 32_768) -> bytes:
    """A dictionary from about ``sample_rows`` rows (those of the least hashes of doc_id; more where rows share one).

    Texts of more than ``sample_chars`` code points give ``SLICES`` slices, evenly from start to
    end, of that many code points together.  Only compression depends on it.  Tasks send hashes
    to the driver, then the sample's rows are read.  zstandard wants several samples: of few
    rows the id arrays are cut in parts, and a last resort takes them as they are.
    """
    import zstandard

    hashed = docs.select(F.xxhash64("doc_id").alias("h"), "text")
    cut = [r.h for r in hashed.select("h").orderBy("h").limit(sample_rows).collect()]
    if not cut:
        return b""
    long, n = F.length("text"), sample_chars // SLICES
    slices = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda k: F.substring("text", F.floor(k * (long - n) / (SLICES - 1)).cast("int") + 1, F.lit(n)))
    sample = F.when(long > sample_chars, slices).otherwise(F.array("text"))
    rows = hashed.where(F.col("h") <= cut[-1]).where("text <> ''").select("h", sample.alias("t")).limit(2 * sample_rows).collect()
    rows.sort(key=lambda r: (r.h, r.t))
    packed = [p for p in tokens.encoder(tokenizer).encode([t for r in rows for t in r.t]) if p]
    for part in (0, 256, 64, 16):
        samples = [p[i : i + part] for p in packed for i in range(0, len(p), part)] if part else packed
        with contextlib.suppress(zstandard.ZstdError):  # too few samples
            return zstandard.train_dictionary(max(256, min(size, sum(map(len, samples)) // 8)), samples).as_bytes()
    return b"".join(packed)[-size:]


def _zdict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class Writer:
    """Appends documents to an open stream; ``close`` adds index and trailer."""

    def __init__(self, stream, dictionary: bytes, level: int = 3) -> None:
        import zstandard

        self.stream = stream
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=_zdict(dictionary)).compress
        self.ids, self.nulls, self.offsets, self.counts = [], [], [], []
        self.at = stream.write(MAGIC + hashlib.sha256(dictionary).digest()) or len(MAGIC) + 32

    def add(self, doc_id: int | None, packed: bytes) -> None:
        frame = self.compress(packed)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.offsets.append(self.at)
        self.counts.append(len(packed) // 4)
        self.stream.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        index = b"".join(np.array(x, dtype=t).tobytes() for x, t in ((self.ids, "<i8"), (self.nulls, "u1"), (self.offsets, "<u8"), (self.counts, "<u8")))
        self.stream.write(index + TRAILER.pack(self.at, len(index), len(self.ids), zlib.crc32(index), MAGIC))


class Reader:
    """Random access to one file through range reads."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        import zstandard

        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, length, n, crc, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        index = self.file.read_at(length, at)
        if zlib.crc32(index) != crc:
            raise ValueError(f"the index of {uri} is damaged")
        self.ids = np.frombuffer(index, "<i8", n, 0)
        self.nulls = np.frombuffer(index, "u1", n, 8 * n)
        self.offsets = np.append(np.frombuffer(index, "<u8", n, 9 * n), np.uint64(at)).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
        self.decompress = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary)).decompress

    def __len__(self) -> int:
        return len(self.ids)

    def frame(self, i: int) -> bytes:
        """Packed ids of the i-th document: one range read."""
        return self._unpack(i, self.file.read_at(int(self.offsets[i + 1] - self.offsets[i]), int(self.offsets[i])))

    def _unpack(self, i: int, frame: bytes) -> bytes:
        packed = self.decompress(frame)
        if len(packed) != 4 * self.counts[i]:
            raise ValueError(f"document {i} has {len(packed)} bytes; the index says {self.counts[i]} ids")
        return packed

    def find(self, doc_id: int) -> bytes | None:
        """Packed ids of the first document with this id, by binary search."""
        first = int(self.nulls.sum())  # null ids sort first
        i = first + int(np.searchsorted(self.ids[first:], doc_id))
        return self.frame(i) if i < len(self) and self.ids[i] == doc_id and not self.nulls[i] else None

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        i = 0
        while i < len(self):  # reads of about 8 MB
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + 8_000_000, side="right")) - 1)
            block = self.file.read_at(int(self.offsets[j] - self.offsets[i]), int(self.offsets[i]))
            for k in range(i, j):
                a, b = int(self.offsets[k] - self.offsets[i]), int(self.offsets[k + 1] - self.offsets[i])
                yield (None if self.nulls[k] else int(self.ids[k])), self._unpack(k, block[a:b])
            i = j


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes ``doc_id, text`` to ``out_dir`` and returns the manifest, one row per file in ascending doc_id.

    Null texts count as empty; each document gets ``end_id``.  Rows with equal or null ids stay
    separate (null ids first, then by text).  Texts of any length are one frame.  Other columns
    are ignored, whatever their names.  An empty table gives no file.
    """
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).hexdigest()
    write_once(f"{out_dir}/dictionary", lambda stream: stream.write(dictionary))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, path, done = tokens.encoder(tokenizer).encode_array, f"{out_dir}/part-{part:06d}.ids", []

        def write(stream) -> None:
            writer = Writer(stream, dictionary)
            for batch in batches:
                ids, at = encode(batch.column(1))
                for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    writer.add(doc_id, ids[a:b].tobytes() + end)
            writer.close()
            done.extend((len(writer.ids), sum(writer.counts)))

        write_once(path, write)
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([done[0]]), pa.array([done[1]], pa.int64()), pa.array([digest])], ["part", "path", "n_docs", "n_tokens", "dict_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(rows.mapInArrow(run, MANIFEST), f"{out_dir}/manifest")


def read_token_files(manifest: DataFrame, out_dir: str) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``; files are read in parallel."""
    bases = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if dictionary is None:
                    system, at = open_fs(f"{out_dir}/dictionary")
                    with system.open_input_stream(at) as stream:
                        dictionary = stream.read()
                start, rows = base or 0, []
                for doc_id, packed in Reader(path, dictionary):
                    rows.append((doc_id, start, len(packed) // 4, zlib.crc32(packed)))
                    start += len(packed) // 4
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return bases.repartition(n, "part").select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), out, tokens.default_tokenizer(), end_id=2), out)
