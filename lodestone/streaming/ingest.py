"""Embedding of chunks by a model, in batches that are checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.constants import EMBED_BATCH

Embed = Callable[[list[str]], list[list[float]]]


def trigram_embedding(dim: int = 64) -> Embed:
    """A deterministic stand-in for a model: hashed character trigrams, unit length."""
    import zlib

    table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)

    def hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 of each three bytes in a row of each text, of all where there are fewer; and the number of the text."""
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        own, text = np.frombuffer(b"".join([*data, b"\0\0"]), dtype=np.uint8), np.repeat(np.arange(len(data)), sizes)
        crc = np.full(len(text), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(3):
            crc = table[(crc ^ own[k : len(text) + k]) & 0xFF] ^ (crc >> 8)
        inside = np.arange(len(text)) < np.repeat(np.cumsum(sizes) - 2, sizes)
        short = np.flatnonzero(sizes < 3)
        return np.r_[~crc[inside], np.array([zlib.crc32(data[i]) for i in short], dtype=np.uint32)], np.r_[text[inside], short]

    def embed(texts: list[str]) -> list[list[float]]:
        h, text = hashes([t.lower().encode() for t in texts])
        out = np.bincount(text * dim + h % dim, weights=np.where(h & 0x10000, 1.0, -1.0), minlength=len(texts) * dim).astype(np.float64).reshape(len(texts), dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()

    return embed


def embed_chunks(chunks: DataFrame, embed: Embed, text: str = "content") -> DataFrame:
    """Adds ``embedding``, asking the model for at most EMBED_BATCH texts at once and checking what it returns."""
    columns = chunks.columns
    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = None
        for batch in batches:
            texts, vectors = [t or "" for t in batch.column(columns.index(text)).to_pylist()], []
            for at in range(0, len(texts), EMBED_BATCH):
                asked = texts[at : at + EMBED_BATCH]
                got = embed(asked)
                dim = dim or (len(got[0]) if got else None)
                if len(got) != len(asked) or not dim or any(len(v) != dim for v in got):
                    raise ValueError("the model returned vectors of another number or width")
                vectors.extend(got)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

    return chunks.mapInArrow(run, schema)


def batch_validity(batches: DataFrame) -> DataFrame:
    """``batch, expected, embedding`` to whether count and widths of each batch hold, the width being that of the first batch."""
    own = batches.groupBy("batch").agg(F.first("expected").alias("expected"), F.count("embedding").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    dim = own.agg(F.min_by("low", "batch").alias("dim"))
    return own.join(F.broadcast(dim)).select("batch", ((F.col("n") == F.col("expected")) & (F.col("low") > 0) & (F.col("low") == F.col("high")) & (F.col("low") == F.col("dim"))).alias("valid"))
