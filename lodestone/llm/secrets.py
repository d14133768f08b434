"""Secret scan with multipart credential linking, in DataFrame operations only.

Base kinds are matched leftmost and without overlap by one regular expression each; places
are running sums of the lengths of matches and of the text between them.  Weak kinds are
parts of a credential and are reported only where complementary parts lie in one scope:

* ``ident``: a named access identifier (user, login, client or key id with a value),
* ``weakhex``: a run of 16 to 23 hexadecimal digits; ``quoted``: a quoted run of 20 to 64,
* ``endpoint``: a URL or IPv4 address.

An ident needs a secret (assign, hex, weakhex, quoted) in its scope, a weak secret needs an
identifier (ident, access), an endpoint needs both.  A scope is ``scope_chars`` code points
to each side of a span's start.  The interval join is a window over the spans of one document
by start with a range frame: one shuffle of spans, no texts, no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, stored, table, two_hashes, whole_row

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, least length of group 2, greatest length of the match.  {16,} and {24,} give
#: the matches of the plain + patterns that have 20 and 24 characters or more.
KINDS: list[tuple[str, str, int, int]] = [
    ("assign", ASSIGN, 6, 0),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", "[0-9a-f]{24,}", 0, 0),
    ("ident", r"""(?i)(user_?name|user|login|client_?id|key_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 0, 0),
    ("weakhex", "[0-9a-f]{16,}", 0, 23),
    ("quoted", r"""["'][A-Za-z0-9+/_=-]{20,64}["']""", 0, 0),
    ("endpoint", r"""https?://[^\x00-\x20"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}""", 0, 0),
]
BASE = 3
IDENTIFIERS, SECRETS = [1, 3], [0, 2, 4, 5]


def _parts(no: int) -> Column:
    """array<struct<kind, i, lead, len, ok>> of the matches of a kind in ``text``."""
    _, pattern, least, most = KINDS[no]
    found, between = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    group = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if least else found
    parts = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), group.alias("g"))

    def part(p: Column, i: Column) -> Column:
        ok = F.length(p["g"]) >= least if least else F.length(p["m"]) <= most if most else F.lit(True)
        return F.struct(F.lit(no).alias("kind"), i.alias("i"), F.length(p["b"]).alias("lead"), F.length(p["m"]).alias("len"), ok.alias("ok"))

    empty = F.array().cast("array<struct<kind:int,i:int,lead:int,len:int,ok:boolean>>")
    return F.when(F.col("text").rlike(pattern), F.transform(parts, part)).otherwise(empty)


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, scope_chars: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` and ``spans``, array<struct<start, kind, end>> by start and kind.

    Null texts count as empty.  Every row is its own document, so repeated rows and null ids
    stay as they are.
    """
    row = docs.select(F.monotonically_increasing_id().alias("__row"), *keep, F.coalesce("text", F.lit("")).alias("text"))
    parts = row.select("__row", *keep, F.explode_outer(F.concat(*(_parts(k) for k in range(len(KINDS))))).alias("p")).select("__row", *keep, "p.*")
    parts = parts.repartition("__row")  # serves both windows and the grouping
    run = Window.partitionBy("__row", "kind").orderBy("i")
    spans = parts.withColumn("end", F.sum(F.col("lead") + F.col("len")).over(run).cast("int")).withColumn("start", F.col("end") - F.col("len"))
    spans = spans.withColumn("kind", F.when(F.col("ok"), F.col("kind")))  # a row without spans, or whose spans all fail, stays
    scope = Window.partitionBy("__row").orderBy("start").rangeBetween(-scope_chars, scope_chars)
    spans = spans.withColumn("id_near", F.max(F.col("kind").isin(IDENTIFIERS)).over(scope)).withColumn("secret_near", F.max(F.col("kind").isin(SECRETS)).over(scope))
    name = {k[0]: i for i, k in enumerate(KINDS)}
    linked = (
        (F.col("kind") < BASE)
        | (F.col("kind") == name["ident"]) & F.col("secret_near")
        | F.col("kind").isin(name["weakhex"], name["quoted"]) & F.col("id_near")
        | (F.col("kind") == name["endpoint"]) & F.col("id_near") & F.col("secret_near")
    )
    span = F.when(linked, F.struct("start", "kind", "end"))
    return spans.groupBy("__row", *keep).agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("__row")


def find_secrets(docs: DataFrame, scope_chars: int = 200) -> DataFrame:
    """Per row of ``doc_id, text``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    A document without spans has the digest of the empty string and ``''``, as have null and
    empty texts.  Texts of any length are searched whole.  Repeated rows get equal rows each, and
    null doc_ids stay.  Spans of equal starts are in the order of KINDS.  Other columns are
    ignored, whatever their names.  An empty table gives no rows.
    """
    found = find_spans(docs.select(F.col("doc_id").cast("long"), "text"), scope_chars, keep=("doc_id",))
    base, count = F.filter("spans", lambda s: s["kind"] < BASE), lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _stretches(found: DataFrame) -> DataFrame:
    """``a, b, stretches``: reported spans (endpoints excepted) of each text, overlapping ones as one, in order."""
    before = Window.partitionBy("a", "b").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("a", "b", F.inline("spans")).where(F.col("kind") < len(KINDS) - 1)
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int"))
    spans = spans.withColumn("no", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = spans.groupBy("a", "b", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("stretches"))


def redact(docs: DataFrame, scope_chars: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each stretch of reported spans (endpoints excepted) replaced by ``mark``; columns as they were, whatever their names.

    Overlapping spans are one stretch.  n_chars, if there, follows the new text.  Null and empty
    texts stay; equal texts share their spans; an empty table gives no rows.  Places only are
    joined to texts, as a written table, so texts move only if that exceeds the broadcast limit.
    """
    a, b = two_hashes("text")
    found = find_spans(docs.select(a, b, "text").where("text is not null"), scope_chars, keep=("a", "b")).where(F.size("spans") > 0).dropDuplicates(["a", "b"])
    places = stored(_stretches(found), shared_dir(docs.sparkSession, "secret-places"))
    joined = docs.select(whole_row(docs).alias("d"), a, b).join(places, ["a", "b"], "left")
    shown, text, end = F.col("stretches"), F.col("d.text"), lambda i: F.coalesce(F.get("stretches", i)["end"], F.lit(0))
    lead = F.transform(shown, lambda s, i: F.concat(F.substring(text, end(i - 1) + 1, s["start"] - end(i - 1)), F.lit(mark)))
    clean = F.concat(F.array_join(lead, ""), F.substring(text, end(F.size(shown) - 1) + 1, F.length(text)))
    new = {"text": F.when(shown.isNotNull(), clean).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(shown.isNotNull(), F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    return joined.select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ",\n".join("({}, '{}', '{}', {}, {})".format(i, k, p.replace("'", "''"), least, most) for i, (k, p, least, most) in enumerate(KINDS))
    return f"""
WITH kinds(kind, name, pattern, least, most) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT r, kind, least, most, string_split_regex(text, pattern) AS b, regexp_extract_all(text, pattern, 0) AS m,
         CASE WHEN least > 0 THEN regexp_extract_all(text, pattern, 2) ELSE [] END AS g FROM d CROSS JOIN kinds WHERE regexp_matches(text, pattern)),
one AS (SELECT r, kind, least, most, b, m, g, unnest(range(1, len(m) + 1)) AS i FROM raw),
placed AS (
  SELECT r, kind, sum(length(b[i]) + length(m[i])) OVER (PARTITION BY r, kind ORDER BY i) AS stop, length(m[i]) AS n,
         CASE WHEN least > 0 THEN length(g[i]) >= least WHEN most > 0 THEN length(m[i]) <= most ELSE true END AS ok FROM one),
spans AS (SELECT r, kind, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE ok),
near AS (
  SELECT *, bool_or(kind IN (1, 3)) OVER w AS id_near, bool_or(kind IN (0, 2, 4, 5)) OVER w AS secret_near
  FROM spans WINDOW w AS (PARTITION BY r ORDER BY start RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING)),
kept AS (
  SELECT near.*, name || ':' || start || ':' || stop AS s FROM near JOIN kinds USING (kind)
  WHERE kind < 3 OR (kind = 3 AND secret_near) OR (kind IN (4, 5) AND id_near) OR (kind = 6 AND id_near AND secret_near)),
grouped AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN grouped USING (r)
"""


ORACLE = _oracle()
