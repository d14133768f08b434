"""Mutations as pure functions of tables: compare-and-swap, publish, upsert, replace, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.constants import LEASE_MINUTES, STALE_MINUTES
from lodestone.functions.text import ref_number

#: event: (states it applies to, the state it leads to)
TRANSITIONS = {"claim": (["pending", "failed"], "processing"), "publishing": (["processing"], "publishing"), "ready": (["publishing"], "ready"), "fail": (["processing"], "failed")}


def apply_transitions(docs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """``id, version, status, lease`` with at most one event ``id, version, event`` each: new status and lease, and whether it applied."""
    joined = docs.join(events, ["id", "version"], "left")
    fits, to = F.lit(False), F.lit(None).cast("string")
    for name, (states, target) in TRANSITIONS.items():
        fits = fits | (F.col("event") == name) & F.col("status").isin(states)
        to = F.when(F.col("event") == name, target).otherwise(to)
    applied = F.coalesce(fits, F.lit(False))
    held = F.when(applied, F.when(to.isin("processing", "publishing"), now + F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"))).otherwise(F.col("lease"))
    return joined.select("id", "version", F.when(applied, to).otherwise(F.col("status")).alias("status"), held.alias("lease"), applied.alias("applied"))


def reconcile(docs: DataFrame, now: Column) -> DataFrame:
    """Expired processing goes back to pending under a new version, expired publishing is published again, stale pending is queued again."""
    expired = F.col("lease") < now
    action = (
        F.when((F.col("status") == "processing") & expired, "requeue_new_version")
        .when((F.col("status") == "publishing") & expired, "republish")
        .when((F.col("status") == "pending") & (F.col("updated_at") < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")), "requeue")
    )
    own = docs.withColumn("action", action).where("action is not null")
    again = F.col("action") == "requeue_new_version"
    return own.select("id", "action", (F.col("version") + again.cast("int")).alias("version"), F.when(again, "pending").otherwise(F.col("status")).alias("status"))


def publish(chunks: DataFrame, published: DataFrame) -> DataFrame:
    """Makes version ``version`` of each ``document_id`` in ``published`` the only one, visible; other documents stay.  Twice is as once."""
    want = published.select("document_id", F.col("version").alias("__v"))
    joined = chunks.join(want, "document_id", "left").where(F.col("__v").isNull() | (F.col("__v") == F.col("document_version")))
    return joined.withColumn("is_published", F.col("is_published") | F.col("__v").isNotNull()).drop("__v")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def upsert_tools(old: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote ``server, tool, description`` over ``id, server, tool, description, active``: known ones are refreshed and active again
    with their id, new ones have a null id, and ones that are gone are inactive."""
    a, b = old.alias("a"), remote.withColumn("__there", F.lit(True)).alias("b")
    joined = a.join(b, ["server", "tool"], "full_outer")
    there = F.coalesce("b.__there", F.lit(False))
    return joined.select("server", "tool", F.col("a.id").alias("id"), F.when(there, F.col("b.description")).otherwise(F.col("a.description")).alias("description"), there.alias("active"))


def replace_all(links: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All links of the keys in ``new`` are replaced."""
    return links.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def purge_tokens(tokens: DataFrame, now: Column, cutoff: Column) -> DataFrame:
    gone = (F.col("expires_at") < now) | F.coalesce(F.col("revoked_at") < cutoff, F.lit(False))
    return tokens.where(~gone)


def revoke(tokens: DataFrame, which: Column, now: Column) -> DataFrame:
    """Sets the time of revocation where it is not set yet."""
    return tokens.withColumn("revoked_at", F.when(which, F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at")))


def delete_document(chunks: DataFrame, document_id, version=None) -> DataFrame:
    match = F.col("document_id") == document_id
    return chunks.where(~(match if version is None else match & (F.col("document_version") == version)))


def span_tree(spans: DataFrame) -> DataFrame:
    """``id, trace_id, parent_id, name`` with the parent's name and the number of direct children: joins on ids within a trace."""
    parents = spans.select("trace_id", F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    children = spans.where("parent_id is not null").groupBy("trace_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    joined = spans.join(parents, ["trace_id", "parent_id"], "left").join(children, ["trace_id", "id"], "left")
    return joined.select("id", "trace_id", "parent_id", "parent_name", F.coalesce("children", F.lit(0)).alias("children"))


def citations_of(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """``message_id, citations`` of the asked messages: their citations ordered by the number in ``ref``; empty without any."""
    order = F.struct(ref_number(F.col("ref")).alias("n"), "ref", "chunk_id", "score")
    found = citations.join(messages.select("message_id").distinct(), "message_id", "left_semi").groupBy("message_id").agg(F.array_sort(F.collect_list(order)).alias("citations"))
    shown = F.transform("citations", lambda c: F.struct(c["ref"].alias("ref"), c["chunk_id"].alias("chunk_id"), c["score"].alias("score")))
    none = F.array().cast("array<struct<ref:string,chunk_id:bigint,score:double>>")
    return messages.select("message_id").distinct().join(found, "message_id", "left").select("message_id", F.coalesce(shown, none).alias("citations"))


def with_citations(messages: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and citations to write, or neither of a message whose citations are not all valid (null quote or score)."""
    bad = citations.where("quote is null or score is null").select("message_id").distinct()
    ok = messages.join(bad.withColumnRenamed("message_id", "id"), "id", "left_anti")
    rows = citations.join(ok.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    return ok, rows.withColumn("score", F.col("score").cast("decimal(5,4)"))
