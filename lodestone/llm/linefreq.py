"""Quality rules with cross-document line frequency, in DataFrame operations only.

A line is normalised (lower case, digits to 0, other than letters and digits to one space)
and hashed; the number of documents of a host (``source``) that have it is counted from one
row per document and line, summed before the shuffle.  The limit is a number of documents,
whatever the host's size: ``most_docs``, or ``long_docs`` for lines of ``LONG_WORDS``
normalised words or more.  A line above its limit is removed everywhere but in the document of
least doc_id that has it, so that no text vanishes from the corpus.  A document that keeps
less than ``least_share`` of its words is rejected.  The base rules are computed in the row.

Texts are read once: base columns, and hash and words of each line, are written to the shared
folder; counting and judging read that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, stored, table, two_hashes, whole_row

#: White space of the rules, as a class of Java's regular expressions.
WHITE = "[ \\x09-\\x0D]"
MOST_DOCS, LONG_DOCS, LONG_WORDS, LEAST_SHARE, SALTS = 50, 10, 10, 0.3, 16


def _tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, f"{WHITE}+", -1), "")


SPAN = 1 << 22


def _covered(at: Column) -> Column:
    """Number of places in the windows that start at ``at``."""
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(x, x + 1, x + 2)))))


def _n_repeat(words: Column, n: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included.

    Windows are sorted as (42 bits of hash, place) packed in one number; those with a neighbour
    of equal hash repeat, and the places they cover are counted once.  Where neighbours of equal
    hash differ in words, or places do not fit, windows are sorted by their words instead.
    """
    places = F.sequence(F.lit(0), n - 3)
    window = lambda i: [F.get(words, i + d) for d in range(3)]
    place = lambda key: F.pmod(key, F.lit(SPAN)).cast("int")

    def same(keys: Column, j: Column, k: Column) -> Column:
        return F.shiftright(F.get(keys, j), 22) == F.shiftright(F.get(keys, k), 22)

    def packed(keys: Column) -> Column:
        held = F.array(F.filter(keys, lambda key, j: same(keys, j, j - 1) | same(keys, j, j + 1)))
        return F.get(F.transform(held, lambda t: F.when(F.size(F.filter(t, lambda key, j: clash(t, j))) == 0, _covered(F.transform(t, place)))), F.lit(0))

    def clash(keys: Column, j: Column) -> Column:
        a, b = window(place(F.get(keys, j))), window(place(F.get(keys, j - 1)))
        return same(keys, j, j - 1) & ~((a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]))

    def by_words(rows: Column) -> Column:
        equal = lambda row, other: (row["a"] == other["a"]) & (row["b"] == other["b"]) & (row["c"] == other["c"])
        twice = F.filter(rows, lambda row, j: equal(row, F.get(rows, j - 1)) | equal(row, F.get(rows, j + 1)))
        return _covered(F.transform(twice, lambda row: row["i"]))

    # each sorted array is computed once
    keys = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.xxhash64(*window(i)), 22).bitwiseOR(i.cast("long"))))
    rows = F.sort_array(F.transform(places, lambda i: F.struct(*(w.alias(c) for w, c in zip(window(i), "abc", strict=True)), i.alias("i"))))
    quick = F.when(n - 3 < SPAN, F.get(F.transform(F.array(keys), packed), F.lit(0)))
    return F.when(n >= 4, F.coalesce(quick, F.get(F.transform(F.array(rows), by_words), F.lit(0)))).otherwise(0)


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``; null texts have no words."""
    text = F.coalesce("text", F.lit(""))
    words = F.transform(F.array(_tokens(text)), lambda w: F.struct(w.alias("w"), F.size(w).alias("n")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WHITE.replace("[", "[^")))
    dup = F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0))
    counted = F.get(F.transform(words, lambda s: F.struct(s["n"].cast("long").alias("n_words"), F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"), _n_repeat(s["w"], s["n"]).cast("long").alias("n_repeat_words"))), F.lit(0))
    out = docs.withColumn("__c", counted)
    return out.select(
        *docs.columns,
        F.col("__c.n_words").alias("n_words"),
        F.col("__c.word_chars").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        F.col("__c.n_repeat_words").alias("n_repeat_words"),
        ((F.col("__c.n_words") < 50) | (100 * F.col("__c.n_repeat_words") > 50 * F.col("__c.n_words"))).alias("base_failed"),
    )


def _normal(text: Column) -> Column:
    """Normalised text; line breaks stay, lines are not trimmed yet."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[1-9]", "0"), "[^0\\p{L}\n]+", " ")


def _lines(text: Column, host: Column) -> Column:
    """array<struct<key, long, words>> of all lines; key is of host and normalised line, words are those of the line as it is."""
    pairs = F.arrays_zip(F.split(text, "\n", -1).alias("raw"), F.split(_normal(text), "\n", -1).alias("line"))

    def entry(p: Column) -> Column:
        line = F.trim(p["line"])
        long = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= LONG_WORDS - 1
        return F.struct(F.xxhash64(F.coalesce(host, F.lit("")), line).alias("key"), long.alias("long"), F.size(_tokens(p["raw"])).cast("long").alias("words"))

    return F.transform(pairs, entry)


def profile(docs: DataFrame, out_dir: str, *keep: Column) -> DataFrame:
    """Written table: ``__row, doc_id``, the columns ``keep``, the base columns and ``lines`` (those with a word)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text", "source")
    ruled = base_rules(own).withColumn("lines", F.filter(_lines(F.coalesce("text", F.lit("")), F.col("source")), lambda x: x["words"] > 0))
    return stored(ruled.drop("text", "source").withColumn("__row", F.monotonically_increasing_id()), f"{out_dir}/profile")


def frequent_lines(profiled: DataFrame, out_dir: str, most_docs: int, long_docs: int) -> DataFrame:
    """``key, first_id`` of the lines above the limits, as a written table."""
    keys = F.array_distinct(F.transform("lines", lambda x: F.struct(x["key"].alias("key"), x["long"].alias("long"))))
    counts = profiled.select("doc_id", F.explode(keys).alias("line")).groupBy("line.key", "line.long").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    above = counts.where(F.col("n") > F.when(F.col("long"), long_docs).otherwise(most_docs))
    return stored(above.select("key", "first_id"), f"{out_dir}/frequent-lines")


def judged(profiled: DataFrame, out_dir: str, most_docs: int = MOST_DOCS, long_docs: int = LONG_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The profile without lines, with ``kept`` and ``removed`` (hashes of the document's removed lines).

    Lines above a limit are by nature those of the most documents: they are joined on hash and
    salt, and broadcast only if the planner finds the written table below its limit.
    """
    frequent = frequent_lines(profiled, out_dir, most_docs, long_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = profiled.select("__row", "doc_id", F.explode("lines").alias("line")).select("__row", "doc_id", "line.key", "line.words", F.pmod(F.col("__row"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = rows.join(frequent, ["key", "salt"]).where(~F.col("first_id").eqNullSafe(F.col("doc_id")))
    gone = gone.groupBy("__row").agg(F.sum("words").alias("gone_words"), F.collect_set("key").alias("gone"))
    left = F.col("n_words") - F.coalesce("gone_words", F.lit(0)) >= least_share * F.col("n_words")
    removed = F.coalesce("gone", F.array().cast("array<long>"))
    out = profiled.drop("lines").join(gone, "__row", "left")
    return out.withColumn("kept", ~F.col("base_failed") & left).withColumn("removed", removed).drop("__row", "gone_words", "gone")


def judge(docs: DataFrame, **limits) -> DataFrame:
    """Per row of ``doc_id, text, source``: ``doc_id``, the base columns, ``kept`` and ``removed`` (hashes of its removed lines).

    Null and empty texts have no words and fail; texts of any length are read whole; a null
    source is a host of its own.  Every row counts as a document, so repeated rows count again
    and keep their own rows; of rows with the least doc_id of a line all keep it.  A null doc_id
    is never the one that keeps a line, unless all rows with that line have none.  Other columns
    are ignored, whatever their names.  An empty table gives no rows.
    """
    out = shared_dir(docs.sparkSession, "lines")
    return judged(profile(docs, out), out, **limits)


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, without their removed lines; columns as they were, whatever their names.

    Verdicts that change something are joined by two hashes of doc_id, text and source, so equal
    rows share one; a document's n_chars, if there, follows its new text.
    """
    out = shared_dir(docs.sparkSession, "lines")
    a, b = two_hashes(F.col("doc_id").cast("long"), F.col("text").isNull(), "text", "source")
    found = judged(profile(docs, out, a, b), out, **limits).where(~F.col("kept") | (F.size("removed") > 0)).dropDuplicates(["a", "b"])
    found = stored(found.select("a", "b", "kept", "removed"), f"{out}/verdicts")
    joined = docs.select(whole_row(docs).alias("d"), a, b).join(found, ["a", "b"], "left").where("kept is null or kept")
    keys = _lines(F.coalesce("d.text", F.lit("")), F.col("d.source"))
    kept = F.filter(F.arrays_zip(F.split("d.text", "\n", -1).alias("raw"), keys.alias("x")), lambda p: (p["x"]["words"] == 0) | ~F.array_contains("removed", p["x"]["key"]))
    shorter = F.size("removed") > 0
    text = F.when(shorter, F.array_join(F.transform(kept, lambda p: p["raw"]), "\n")).otherwise(F.col("d.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(shorter, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    return joined.select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("removed")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY r),
l AS (SELECT r, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
              trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[^0\p{L}]+', ' ', 'g'), ' ') AS key
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r),
f AS (SELECT host, key, count(DISTINCT r) AS n, min(doc_id) AS first_id FROM lw GROUP BY host, key),
above AS (SELECT host, key, first_id FROM f WHERE n > CASE WHEN len(string_split(key, ' ')) >= 10 THEN 10 ELSE 50 END),
gone AS (SELECT r, sum(words) AS words FROM lw JOIN above USING (host, key) WHERE first_id IS DISTINCT FROM doc_id GROUP BY r),
b AS (
  SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(words, 0) >= 0.3::DOUBLE * n_words AS kept
FROM b LEFT JOIN gone USING (r)
"""
