"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Targets: a budget is shared by weight; a source's target stops at ``most`` times its size, and
what is left over is shared again by weight among the others.

Taking: every document has a hash in hexadecimal digits.  A target is a number of whole copies
of its source and a remainder, and one copy more goes to the documents below a threshold of
hashes.  The threshold comes from histograms: sizes are added up by source and leading digits;
in the bucket where the running sum passes the remainder the next digits are counted, and so
on until the bucket has one row.  So only the rows of that bucket are read again (a 256th each
time), nothing is sorted, and a larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, stored, table
from lodestone.llm.merkle import numbered

WEIGHTS, SHARE, MOST, DIGITS, SALTS = (5, 2, 1), 1.5, 2, 2, 32
#: Digits of a hash: 32 of doc_id and size, 16 of the row's number for rows that are equal in both.
LENGTH = 48


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+", -1), "")
    return F.size(words).cast("long")


def sized(docs: DataFrame, out: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Written table ``doc_id, key, size, h`` and the columns ``keep`` (as ``keep.*`` in a struct)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b")).alias("key"), n_words(F.col("text")).alias("size"), *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("keep")] if keep else []))
    same = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("size").cast("string")))
    return stored(own.withColumn("h", F.concat(same, F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0"))), f"{out}/sized")


def targets(sources: DataFrame, budget: float, most: float = MOST) -> DataFrame:
    """``sources`` (a written table with ``size, weight``) with ``target``: budget by weight, at most ``most`` times the size.

    The level of a unit of weight rises until the targets reach the budget: each round adds up
    the sources that are full and shares the rest among the others.
    """
    cap, level = F.col("size") * F.lit(float(most)), 0.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        at = sources.agg(F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        risen = (budget - (at["held"] or 0.0)) / at["open"] if at["open"] else level
        if risen <= level:
            return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
        level = risen


def thresholds(rows: DataFrame, wanted: DataFrame, out: str) -> DataFrame:
    """``key, below, also`` for ``wanted`` (key, remainder): rows with ``h < below`` are taken, and the row ``also`` where it brings the sum nearer.

    ``rows`` has ``key, h, size``; keys whose rows all fit are left out.
    """
    left = wanted.select("key", F.lit("").alias("prefix"), "remainder")
    inside, done, digits = rows.select("key", "h", "size"), None, 0
    while digits < LENGTH:
        digits += DIGITS
        bucket = F.substring("h", 1, digits)
        sums = inside.groupBy("key", bucket.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        running = F.sum("size").over(Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))  # at most 16 ** DIGITS rows a key
        sums = sums.withColumn("upto", running).join(left.select("key", "remainder"), "key")
        edge = sums.where("upto > remainder and upto - size <= remainder").select("key", "prefix", (F.col("remainder") - (F.col("upto") - F.col("size"))).alias("remainder"), "size", "rows")
        edge = stored(edge, f"{out}/edge-{digits}")
        inside = inside.withColumn("prefix", bucket).join(edge.select("key", "prefix"), ["key", "prefix"], "left_semi").drop("prefix")
        inside = stored(inside, f"{out}/inside-{digits}")
        single = edge.where("rows = 1" if digits < LENGTH else "true").join(inside.groupBy("key").agg(F.min("h").alias("h")), "key")
        found = single.select("key", F.col("h").alias("below"), (2 * F.col("remainder") >= F.col("size")).alias("also"))
        done = found if done is None else done.unionByName(found)
        left = edge.where("rows > 1")
        if not left.limit(1).count():
            break
        inside = inside.join(left.select("key"), "key", "left_semi")
    return stored(done, f"{out}/thresholds")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``doc_id, size, source_size, target, copies, taken`` (and ``keep``, a struct of the columns named).

    Sources in order of code points, null last, have the ``weights`` in turn; ``share`` of all
    words is the budget.  Null, empty and blank texts have size 0 and nothing to take; texts of
    any length are counted whole.  Documents are taken whole, so a source's words differ from
    its target by at most half of one document.  Ties: rows of one doc_id and size are taken in the order of
    their numbers, so the words taken do not depend on it; repeated rows count again; a
    null doc_id is a document.  Columns that are not named are ignored.  An empty table gives
    no rows.
    """
    out = shared_dir(docs.sparkSession, "mix")
    rows = sized(docs, out, keep)
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), f"{out}/sizes")
    # the sources' numbers, without one task for all of them
    sources = numbered(groups.withColumn("all", F.lit(0)), "all", ["key"], f"{out}/sources").drop("all", "tree", "n")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    sources = stored(sources.select("key", "size", weight.alias("weight")), f"{out}/weights")
    total = sources.agg(F.sum("size")).first()[0] or 0
    aimed = targets(sources, share * total, most)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    aimed = aimed.withColumn("whole", whole).withColumn("remainder", F.col("target") - F.col("whole") * F.col("size"))
    aimed = stored(aimed.select("key", F.col("size").alias("source_size"), "target", "whole", "remainder"), f"{out}/targets")
    cut = thresholds(rows, aimed.where("remainder > 0"), out)
    # the remainder is below the source's size, so a source without a threshold takes no further copy
    plan = stored(aimed.drop("remainder").join(cut, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), f"{out}/plan")
    salt = F.pmod(F.crc32(F.col("h").cast("binary")), F.lit(SALTS)).cast("int")
    further = F.coalesce((F.col("h") < F.col("below")) | ((F.col("h") == F.col("below")) & F.col("also")), F.lit(False))
    copies = F.col("whole") + further.cast("long")
    made = rows.withColumn("salt", salt).join(plan, ["key", "salt"]).withColumn("copies", copies)
    return made.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["keep"] if keep else []))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns it had."""
    made = mix(docs, keep=tuple(docs.columns), **how)
    return made.where("copies > 0").select("keep", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("keep.*")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (
  SELECT *, 1.5::DOUBLE * sum(n) OVER () AS budget, coalesce(sum(2 * n) OVER o, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open FROM s
  WINDOW o AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT coalesce(max((budget - held) / open), 0) AS level FROM c),
t AS (SELECT source, n, least(2 * n, level * w) AS target FROM s, lev),
r AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.doc_id, size, n, target, whole, target - whole * n AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size) ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN upto <= budget OR (upto - size <= budget AND 2 * (budget - (upto - size)) >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
