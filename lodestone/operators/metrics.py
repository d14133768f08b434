"""Retrieval metrics, gates and differences to a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_metrics(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case of ``name, expected array<long>``, from ``name, rank, document_id``: hits and reciprocal rank; null where nothing is expected."""
    own = results.join(cases, "name", "left").select("name", "rank", "document_id", F.array_contains("expected", F.col("document_id")).alias("expected"))
    return matched_metrics(own, cases.select("name", (F.size("expected") > 0).alias("configured")))


def matched_metrics(results: DataFrame, cases: DataFrame) -> DataFrame:
    """The same from ``name, rank, document_id, expected boolean`` and ``name, configured boolean``."""
    found = results.groupBy("name").agg(F.min(F.when(F.col("expected"), F.col("rank"))).alias("first"), F.count("document_id").alias("result_count"))
    own = cases.join(found, "name", "left").withColumn("result_count", F.coalesce("result_count", F.lit(0).cast("long")))
    value = lambda c: F.when(F.col("configured"), F.coalesce(c, F.lit(0)).cast("double"))
    return own.select("name", "result_count", value((F.col("first") <= 1).cast("int")).alias("hit1"), value((F.col("first") <= 3).cast("int")).alias("hit3"), value(F.col("first").isNotNull().cast("int")).alias("hit"), value(1 / F.col("first")).alias("mrr"))


def cited_metrics(cited: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case of ``name, configured, require_citation``, from ``name, document_id, expected`` of the documents cited.

    ``citation_met`` is null where none is required, ``expected_cited`` where nothing is expected.
    """
    found = cited.groupBy("name").agg(F.count("document_id").alias("n"), F.max(F.coalesce("expected", F.lit(False))).alias("hit"))
    own = cases.join(found, "name", "left")
    return own.select("name", F.when(F.col("require_citation"), F.coalesce(F.col("n") > 0, F.lit(False))).alias("citation_met"), F.when(F.col("configured"), F.coalesce("hit", F.lit(False))).alias("expected_cited"))


def report_line(row: Column) -> Column:
    """A case as a line of a JSON report; values that it lacks are left out."""
    return F.to_json(row)


def write_report(cases: DataFrame, path: str) -> None:
    """The report as JSON lines, one case each, written where the rows lie."""
    cases.select(report_line(F.struct("*")).alias("value")).write.text(path)


def gate(metrics: DataFrame, least: float = 1.0) -> DataFrame:
    """Means over configured cases and the verdict; a metric without any value fails.  ``unique_rate`` is over all cases."""
    rate = F.when(F.col("result_count") == 0, 1.0).otherwise(1 - F.col("duplicates") / F.col("result_count"))
    means = metrics.agg(*(F.avg(c).alias(c) for c in ("hit1", "hit3", "mrr")), F.avg(rate).alias("unique_rate"))
    ok = lambda c: F.coalesce(F.col(c) >= least, F.lit(False))
    names = ("hit1", "hit3", "mrr", "unique_rate")
    reasons = F.array_compact(F.array(*(F.when(~ok(c), F.lit(c)) for c in names)))
    return means.select("*", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"))


def compare(current: DataFrame, base: DataFrame) -> DataFrame:
    """Scores by case next to the baseline's; null where the baseline lacks the case."""
    return current.join(base.select("name", F.col("score").alias("base_score")), "name", "left").withColumn("change", F.col("score") - F.col("base_score"))


def regressed(current: DataFrame, base: DataFrame, least: float) -> DataFrame:
    return current.join(base.select("name", F.col("score").alias("b")), "name").agg(F.coalesce(F.max(F.col("b") - F.col("score") >= least), F.lit(False)).alias("regressed"))


def markdown(rows: DataFrame) -> str:
    """A Markdown table of a small report."""
    names = rows.columns
    body = ["| " + " | ".join("—" if v is None else str(v) for v in r) + " |" for r in rows.collect()]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body])
