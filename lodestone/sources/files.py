"""File sources: text and markdown files, glyph pages, reports and test sets, and guards of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.constants import MAX_FILE_BYTES


def file_type(name: Column) -> Column:
    """Type by case-sensitive suffix; null for others."""
    return F.when(name.endswith(".txt"), "txt").when(name.endswith(".md"), "md").when(name.endswith(".pdf"), "pdf")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, file_type, length, text`` of accepted files (type known, at most 10 MiB), whole text verbatim."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_FILE_BYTES)
    own = files.withColumn("file_type", file_type(F.col("path"))).where(F.col("file_type").isin("txt", "md"))
    return own.select("path", "file_type", "length", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, reason`` of files that the guards turn away; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    reason = F.when(file_type(F.col("path")).isNull(), "type").when(F.col("length") > MAX_FILE_BYTES, "size")
    return files.select("path", reason.alias("reason")).where("reason is not null")


def page_text(glyphs: DataFrame) -> DataFrame:
    """``document_id, page, text`` from ``document_id, page, seq, x, y, w, s``.

    Glyphs go by y descending, then x, then seq; a fall in y of more than 2 starts a line, a
    gap of more than 1 to the right of the last glyph puts a space.  Blank pages stay.
    """
    order = Window.partitionBy("document_id", "page").orderBy(F.col("y").desc(), "x", "seq")
    last_y, right = F.lag("y").over(order), F.lag(F.col("x") + F.col("w")).over(order)
    lead = F.when(last_y - F.col("y") > 2, "\n").when(F.col("x") - right > 1, " ").otherwise("")
    placed = glyphs.withColumn("part", F.concat(F.coalesce(lead, F.lit("")), F.coalesce("s", F.lit("")))).withColumn("n", F.row_number().over(order))
    parts = F.array_sort(F.collect_list(F.struct("n", "part")))
    return placed.groupBy("document_id", "page").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))


def text_of_glyphs(glyphs: Column) -> Column:
    """What ``page_text`` makes of a page, from all its glyphs as an array of ``x, y, w, s`` in order of ``seq``: a row each, no glyph is shuffled."""
    # y descending, nulls last, nan first; then x, nulls first, then seq
    down = lambda g: F.when(F.isnan(g["y"]), float("-inf")).otherwise(-g["y"])
    keyed = F.transform(glyphs, lambda g, seq: F.struct(g["y"].isNull().alias("last"), down(g).alias("down"), g["x"].alias("x"), seq.alias("seq"), g["y"].alias("y"), g["w"].alias("w"), g["s"].alias("s")))

    def parts(placed: Column) -> Column:
        def part(g: Column, i: Column) -> Column:
            before = F.get(placed, i - 1)
            lead = F.when(before["y"] - g["y"] > 2, "\n").when(g["x"] - (before["x"] + before["w"]) > 1, " ")
            return F.concat(F.coalesce(lead, F.lit("")), F.coalesce(g["s"], F.lit("")))

        return F.array_join(F.transform(placed, part), "")

    return F.transform(F.array(F.array_sort(keyed)), parts)[0]  # sorted once for all places


def numbered(rows: DataFrame, key: str, groups: list[str] | None = None, span: int = 4096) -> DataFrame:
    """``rows`` with ``position`` from 1 in order of the integer ``key`` (per group): counts of stretches of ``span`` keys, and places in them.

    Stretches are added up within spans of ``span`` of them, and these over all, so no task
    holds more than one stretch or span, and only a row for each ``span`` ** 2 keys is ordered as
    a whole.
    """
    groups = groups or []
    own = rows.withColumn("__stretch", F.floor(F.col(key) / span))
    counts = own.groupBy(*groups, "__stretch").agg(F.count("*").alias("__n")).withColumn("__span", F.floor(F.col("__stretch") / span))

    def before(by: list, order: str) -> Column:
        return F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    spans = counts.groupBy(*groups, "__span").agg(F.sum("__n").alias("__n"))
    spans = spans.select(*groups, "__span", before(groups or [F.lit(0)], "__span").alias("__base"))
    starts = counts.withColumn("__start", before([*groups, "__span"], "__stretch")).drop("__n").join(spans, [*groups, "__span"])
    starts = starts.select(*groups, "__stretch", (F.col("__start") + F.col("__base")).alias("__start"))
    placed = own.withColumn("__place", F.row_number().over(Window.partitionBy(*groups, "__stretch").orderBy(key)))
    joined = placed.join(starts, [*groups, "__stretch"])
    return joined.withColumn("position", F.col("__start") + F.col("__place")).drop("__stretch", "__start", "__place")


def keyset_batches(rows: DataFrame, key: str, after=None, n: int = 1000) -> DataFrame:
    """The whole keyset scan beyond ``after``: every row with its ``batch`` (from 0) of ``n`` rows and ``position`` (from 1)."""
    own = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return numbered(own, key).withColumn("batch", F.floor((F.col("position") - 1) / n))


def next_batch(rows: DataFrame, key: str, after, n: int = 1000) -> DataFrame:
    """Keyset batch: the next ``n`` rows with a key beyond ``after``, in order."""
    own = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return own.orderBy(key).limit(n)
