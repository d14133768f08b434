"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, linefreq, neardup, packing, secrets, tokens
from lodestone.llm.common import discard, shared_dir, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; lines above the limits are removed from the others.

    Null and empty texts have no words and go.  Repeated rows count and are judged each; rows with
    a null doc_id or source stay as any other.  An empty table gives no rows.
    """
    return linefreq.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class stays.

    Of its repeated rows one stays, that of least text; null and empty texts, and rows with a null
    doc_id, are in a class of their own and stay.  An empty table gives no rows.
    """
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts are clean, repeated rows share a verdict, an empty table gives no rows."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null texts and repeated rows as they are; an empty table gives no rows."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024: one row per piece; a null or empty text is its end id, repeated rows are packed each, an empty table gives no rows."""
    return packing.pack_documents(docs, tokens.default_tokenizer(), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: No SQL: near duplicates by sketches and byte-level ids are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; what a stage has read is removed when its own rows are written."""
    out, docs = shared_dir(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{out}/{k}-{name}")
        discard(out, keep=(f"{k}-{name}",))
    return docs
