"""The entities as views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import fixed_windows
from lodestone.shared import shared_dir, stored

CHUNKS_PER_DOCUMENT = 100_000  # ids: document * this + index


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Fixed-window chunks of ``documents``: knowledge base = lang, name = source, version 1, published."""
    docs = load(spark, sf_dir, "documents")
    pieces = docs.select("doc_id", "lang", "source", F.posexplode(fixed_windows(F.coalesce("text", F.lit("")), size, overlap)).alias("chunk_index", "content"))
    return pieces.select(
        (F.col("doc_id") * CHUNKS_PER_DOCUMENT + F.col("chunk_index")).alias("id"),
        F.col("lang").alias("kb"),
        F.col("doc_id").alias("document_id"),
        F.lit(1).cast("bigint").alias("document_version"),
        "chunk_index",
        "content",
        F.col("source").alias("document_name"),
        F.lit(True).alias("is_published"),
    )


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as a written table, for plans that read them more than once."""
    return stored(chunks(spark, sf_dir), f"{shared_dir(spark, 'chunks')}/chunks")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
