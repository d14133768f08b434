"""Span trees of any depth: depth, path and root of every span, by pointer jumping.

Each round doubles the number of steps that a span knows of its way up, so rounds grow with the
logarithm of the deepest trace; each is a join on ids within the trace, written to the shared
folder.  A span whose way ends at a missing parent is an orphan; one whose way has not ended
after enough rounds for all spans of its trace is on a cycle or below one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import shared_dir, stored


def span_paths(spans: DataFrame) -> DataFrame:
    """``id, trace_id, status, depth, root_id, path`` of ``id, trace_id, parent_id``.

    status is ``ok``, ``orphan`` (depth, root and path as from the topmost span that is there)
    or ``cycle`` (null for these).  path holds the ids from the root down.  Rows without an id
    are left out; of repeated ids of a trace the least parent counts, null last.  A span is not
    its own parent: it is a cycle.
    """
    out = shared_dir(spans.sparkSession, "span-paths")
    own = spans.where("id is not null").groupBy("trace_id", "id").agg(F.min("parent_id").alias("parent_id"))
    there = own.select("trace_id", F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    begun = own.join(there, ["trace_id", "parent_id"], "left")
    # up: the span to go on from, null at the end of the way; path: ids from below it down to the span
    begun = begun.select("trace_id", "id", F.when(F.col("there"), F.col("parent_id")).alias("up"), (F.col("parent_id").isNotNull() & F.col("there").isNull()).alias("orphan"), F.array("id").alias("path"))
    now, done, steps = stored(begun, f"{out}/0"), None, 1
    longest = own.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        over = now.where("up is null")
        done = over if done is None else done.unionByName(over)
        left = now.where("up is not null")
        if steps > longest or not left.limit(1).count():
            break
        seen = done.unionByName(left).select("trace_id", F.col("id").alias("up"), F.col("up").alias("next"), F.col("orphan").alias("lost"), F.col("path").alias("head"))
        joined = left.drop("orphan").join(seen, ["trace_id", "up"])
        now = stored(joined.select("trace_id", "id", F.col("next").alias("up"), F.col("lost").alias("orphan"), F.concat("head", "path").alias("path")), f"{out}/{steps}")
        steps *= 2
    ended = done.select("id", "trace_id", F.when(F.col("orphan"), "orphan").otherwise("ok").alias("status"), (F.size("path") - 1).alias("depth"), F.get("path", F.lit(0)).alias("root_id"), "path")
    none = F.lit(None)
    return ended.unionByName(left.select("id", "trace_id", F.lit("cycle").alias("status"), none.cast("int").alias("depth"), none.cast(spans.schema["id"].dataType).alias("root_id"), none.cast(ended.schema["path"].dataType).alias("path")))


def append_spans(log: DataFrame, new: DataFrame) -> DataFrame:
    """Span rows to add: those of ``new`` with an id that the log does not have."""
    return new.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti")


def of_conversation(spans: DataFrame, conversations: DataFrame) -> DataFrame:
    """``spans`` of the conversations asked for, with ``seq`` by start and id within each."""
    from pyspark.sql import Window

    own = spans.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return own.withColumn("seq", F.row_number().over(Window.partitionBy("conversation_id").orderBy("started_at", "id")))
