"""Rank fusion, admission, exact-content dedup, top-k and neighbour windows over ranked lists.

A ranked list has an explicit position; every operator carries ``query_id``.
The order is: fuse, admit, dedup, top-k, neighbours, dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.constants import KEYWORD_ADMISSION, KEYWORD_WEIGHT, RRF_K, TRIM_CLASS, VECTOR_ADMISSION, VECTOR_WEIGHT
from lodestone.functions.text import dedup_key


def fuse(ranked: DataFrame) -> DataFrame:
    """``query_id, path ('vector' or 'keyword'), id, pos, score`` to one row per id, ranked.

    fusion is the sum of weight / (60 + pos) as given; score the greatest of the paths; a path
    that did not find the id has a null score.  Order: fusion desc, score desc, id.
    """
    weight = F.when(F.col("path") == "vector", VECTOR_WEIGHT).otherwise(KEYWORD_WEIGHT)
    fused = ranked.groupBy("query_id", "id").agg(
        F.sum(F.when(F.col("path") == "vector", weight / (RRF_K + F.col("pos")))).alias("v"),
        F.sum(F.when(F.col("path") != "vector", weight / (RRF_K + F.col("pos")))).alias("k"),
        F.max("score").alias("score"),
        F.max(F.when(F.col("path") == "vector", F.col("score"))).alias("vector_score"),
        F.max(F.when(F.col("path") != "vector", F.col("score"))).alias("keyword_score"),
    )
    fused = fused.withColumn("fusion", F.coalesce("v", F.lit(0.0)) + F.coalesce("k", F.lit(0.0))).drop("v", "k")
    order = Window.partitionBy("query_id").orderBy(F.col("fusion").desc(), F.col("score").desc(), "id")
    return fused.withColumn("pos", F.row_number().over(order))


def admitted(vector: Column, keyword: Column) -> Column:
    """A path that did not find the row is null, not zero."""
    return F.coalesce(vector >= VECTOR_ADMISSION, F.lit(False)) | F.coalesce(keyword >= KEYWORD_ADMISSION, F.lit(False))


def admission_stats(fused: DataFrame) -> DataFrame:
    ok = admitted(F.col("vector_score"), F.col("keyword_score"))
    return fused.groupBy("query_id").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("vector_score") < VECTOR_ADMISSION).alias("vector_below"),
        F.count_if(F.col("keyword_score") < KEYWORD_ADMISSION).alias("keyword_below"),
        F.count_if(ok).alias("admitted"),
        F.count_if(~ok).alias("rejected"),
    )


def first_of_content(rows: DataFrame, keys: list[str], content: str = "content", pos: str = "pos") -> DataFrame:
    """The first row by position of each normalised content within ``keys``; empty contents always stay."""
    body = F.coalesce(F.col(content), F.lit(""))
    blank = ~body.rlike(f"[^{TRIM_CLASS}]")
    # no text in a shuffle or sort key; a blank row has a key of its own, so one pass serves all
    key = F.when(blank, F.concat(F.lit("b"), F.col(pos).cast("string"))).otherwise(F.md5(dedup_key(body)))
    own = rows.withColumn("__key", key).withColumn("__blank", blank)
    order = Window.partitionBy(*keys, "__key").orderBy(pos)
    return own.withColumn("__n", F.row_number().over(order)).where("__n = 1 or __blank").drop("__key", "__blank", "__n")


def suppressed(rows: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Rows that ``first_of_content`` drops, counted per ``keys``: partial sums, no window."""
    key = dedup_key(F.coalesce(F.col(content), F.lit("")))
    own = rows.withColumn("__key", F.when(key != "", F.md5(key)))
    groups = own.groupBy(*keys, "__key").agg(F.count("*").alias("n"))
    return groups.groupBy(*keys).agg(F.sum(F.when(F.col("__key").isNotNull(), F.col("n") - 1).otherwise(0)).alias("suppressed"))


def admit_dedup_top_k(fused: DataFrame, top_k: int) -> DataFrame:
    """Admission, then dedup, then the first ``top_k`` by position; ``rank`` counts from 1."""
    ok = fused.where(admitted(F.col("vector_score"), F.col("keyword_score")))
    unique = first_of_content(ok, ["query_id"])
    order = Window.partitionBy("query_id").orderBy("pos")
    return unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def neighbor_requests(anchors: DataFrame) -> DataFrame:
    """Distinct coordinates of the chunks before and after each anchor."""
    index = F.explode(F.filter(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1), lambda x: x >= 0))
    return anchors.select("document_id", "document_version", index.alias("chunk_index")).distinct()


def with_neighbors(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Anchors, then their neighbours by anchor rank, the one before first; then content dedup over the list.

    A neighbour that is an anchor of the query is skipped, one that several anchors want goes to
    the best of them, and it inherits that anchor's score.  Of rows with equal coordinates the
    largest id counts.
    """
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("chunk_index") - 1).alias("want")), F.struct(F.lit(1).alias("side"), (F.col("chunk_index") + 1).alias("want"))))
    wanted = anchors.select("query_id", F.col("id").alias("neighbor_of"), "rank", "score", "document_id", "document_version", sides.alias("s")).select("*", "s.side", F.col("s.want").alias("chunk_index")).drop("s").where("chunk_index >= 0")
    at, shown = ["document_id", "document_version", "chunk_index"], chunks.where("is_published")
    # coordinates first, then the largest id of each, contents last and for neighbours only
    there = shown.select(*at, "id").join(wanted.select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.max("id").alias("id"))
    near = wanted.join(there, at)
    near = near.join(anchors.select("query_id", "id"), ["query_id", "id"], "left_anti")
    claim = Window.partitionBy("query_id", "id").orderBy("rank", "side")
    near = near.withColumn("claim", F.row_number().over(claim)).where("claim = 1").drop("claim").withColumn("tier", F.lit(1))
    near = near.join(shown.select("id", "content"), "id")
    first = anchors.select("query_id", F.lit("").alias("neighbor_of"), "rank", F.lit(0).alias("side"), "score", "document_id", "document_version", "chunk_index", "id", "content", F.lit(0).alias("tier"))
    both = first.unionByName(near.withColumn("neighbor_of", F.col("neighbor_of").cast("string")).select(*first.columns))
    order = Window.partitionBy("query_id").orderBy("tier", "rank", "side")
    unique = first_of_content(both.withColumn("pos", F.row_number().over(order)), ["query_id"])
    return unique.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).drop("tier", "side")
