"""URL filter: host and path rules, then a tree of path templates per host, in DataFrame operations only.

Templates grow segment by segment, over all segments: at each node (host and template so far)
a segment stays literal where at least ``LEAST_PAGES`` pages of the node have it, and becomes
``*`` elsewhere.  The bar is a number of pages, so a branch is told apart on hosts of any size.
Literals of a level are a written table; pages' hosts, paths and templates are written every
WRITTEN passes and at the end, so that passes are not repeated.  Labels count good and bad
pages per template.  Then branches are merged from the last place to the first: those that
differ at one place only are siblings, and a branch whose bad rate is within ``NEAR`` standard
errors of the siblings' pooled rate, or that has no label, gets ``*`` there.  A branch is
blocked if it has a label and its bad rate, smoothed with ``WEIGHT`` pages of the overall rate, reaches
``MOST_BAD``.  A page is labelled through the number that ends its path (the document's id);
bad means toxic or of quality 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, shared_dir, stored, table

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
LEAST_PAGES, NEAR, WEIGHT, MOST_BAD, SALTS = 10, 2.0, 20.0, 0.5, 8
#: Passes after which pages with their templates so far are written.
WRITTEN = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null.  Of equal lengths the first listed wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):  # later ones override
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def templates(urls: DataFrame, out_dir: str) -> tuple[DataFrame, int]:
    """``urls`` (with ``host, path``) with ``template`` (literal segments and ``*``, ``/``-joined), and the number of levels that can have literals.

    A level is one pass that counts segments by node, summed before the shuffle.  Passes end
    where no node has ``LEAST_PAGES`` pages that go deeper: all that is left is ``*``.
    """
    rows = urls.withColumn("segments", F.array_remove(F.split("path", "/", -1), "")).withColumn("template", F.lit(""))
    rows, level = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")), 0
    while True:
        here = rows.where(F.size("segments") > level).select(F.struct("host", "template").alias("node"), F.get("segments", F.lit(level)).alias("segment"))
        counts = here.rollup("node", "segment").agg(F.count("*").alias("n"), F.grouping("segment").alias("whole"), F.grouping("node").alias("all"))
        counts = stored(counts.where(F.col("n") >= LEAST_PAGES).where("all = 0").select("node.host", "node.template", "segment", "whole"), f"{out_dir}/level-{level}")
        if not counts.where("whole = 1").limit(1).count():
            break
        literal = counts.where("whole = 0").select("host", "template", "segment", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("literal"))
        met = rows.withColumn("segment", F.get("segments", F.lit(level))).join(literal, ["host", "template", "segment", "salt"], "left")
        grown = F.concat_ws("/", F.nullif("template", F.lit("")), F.when(F.col("literal"), F.col("segment")).otherwise("*"))
        rows = met.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(grown)).drop("segment", "literal")
        level += 1
        if level % WRITTEN == 0:  # so that no pass repeats the joins of all passes before it
            rows = stored(rows, f"{out_dir}/rows-{level}")
    rest = F.array_repeat(F.lit("*"), F.greatest(F.size("segments") - level, F.lit(0)))
    rows = rows.withColumn("template", F.array_join(F.concat(F.array_remove(F.array("template"), ""), rest), "/")).drop("segments", "salt")
    return stored(rows, f"{out_dir}/pages"), level


def branches(counts: DataFrame, levels: int, out_dir: str) -> DataFrame:
    """``host, template, branch, n, bad``: the merged branch (an array of segments) of each template of ``counts`` (host, template, n, bad)."""
    tree = counts.withColumn("branch", F.split("template", "/", -1))
    for place in reversed(range(levels)):
        sums = tree.where(F.size("branch") > place).groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        wild = F.transform("branch", lambda s, i: F.when(i == place, "*").otherwise(s))
        sums = sums.withColumn("to", wild)
        pooled = sums.groupBy("host", "to").agg(F.try_divide(F.sum("bad"), F.sum("n")).alias("rate"))
        rate = F.col("rate")
        near = (F.col("n") == 0) | (F.abs(F.try_divide("bad", "n") - rate) <= NEAR * F.sqrt(F.try_divide(rate * (1 - rate), F.col("n"))))
        moved = sums.join(pooled, ["host", "to"]).where(near).where(F.col("branch") != F.col("to")).select("host", "branch", "to")
        tree = stored(tree.join(moved, ["host", "branch"], "left").withColumn("branch", F.coalesce("to", "branch")).drop("to"), f"{out_dir}/tree-{place}")
    return tree


def blocked_templates(paged: DataFrame, labels: DataFrame, levels: int, out_dir: str) -> DataFrame:
    """``host, template`` of the templates to block, given ``host, path, template`` and ``doc_id, quality, toxic``."""
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("number")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    numbered = paged.select("host", "template", F.regexp_extract("path", "([0-9]+)[^0-9/]*/?$", 1).try_cast("long").alias("number"))
    known = numbered.where("number is not null").join(bad, "number")
    every = known.select("host", "template", F.lit(1).alias("n"), "bad").unionByName(numbered.select("host", "template", F.lit(0).alias("n"), F.lit(0).alias("bad")))
    counts = stored(every.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), f"{out_dir}/templates")
    overall = counts.agg(F.try_divide(F.sum("bad"), F.sum("n")).alias("rate")).first().rate or 0.0
    tree = branches(counts, levels, out_dir)
    merged = tree.groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + WEIGHT * overall) / (F.col("n") + WEIGHT)
    return stored(tree.select("host", "template", "branch").join(merged.where((F.col("n") > 0) & (purity >= MOST_BAD)), ["host", "branch"]).select("host", "template"), f"{out_dir}/blocked")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Per row of ``page_id, url``: ``page_id, host, path, rule, verdict, template``.

    Null urls and urls without ``://`` have empty host and path and share one template.  Urls of
    any length are read whole.  Repeated rows count as pages each; rows of one doc_id in the
    labels are bad if one of them is.  A segment ``*`` counts as a wildcard.  Of rules of equal
    length the first listed wins.  Other columns are ignored, whatever their names.  Without
    labels no template is blocked; an empty table gives no rows.
    """
    out = shared_dir(pages.sparkSession, "url-tree")
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    paged, levels = templates(urls, out)
    blocked = blocked_templates(paged, labels, levels, out).withColumn("blocked", F.lit(True))
    discard(out, keep=("pages", "blocked"))
    blocked = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = paged.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(blocked, ["host", "template", "salt"], "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "template")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    def fits(rule: str) -> str:
        name, _, start = rule.partition("/")
        return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}'))"

    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{k}'" for k, r in ordered)
    return f"""
WITH RECURSIVE rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS host, rest FROM rest),
u AS (SELECT row_number() OVER () AS r, page_id, translate(host, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(host) + 1), '^([^?#]*)', 1) AS path FROM h),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM u),
grow AS (
  SELECT r, host, segments, 0 AS d, '' AS template FROM s
  UNION ALL
  SELECT r, host, segments, d + 1, CASE WHEN d > 0 THEN template || '/' ELSE '' END
         || CASE WHEN count(*) OVER (PARTITION BY host, template, segments[d + 1]) >= {LEAST_PAGES} THEN segments[d + 1] ELSE '*' END
  FROM grow WHERE d < len(segments)),
p AS (SELECT s.r, page_id, s.host, path, template FROM s JOIN grow ON grow.r = s.r AND grow.d = len(s.segments)),
b AS (SELECT doc_id AS number, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT host, template, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM (SELECT *, TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS BIGINT) AS number FROM p) LEFT JOIN b USING (number) GROUP BY host, template),
o AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0), 0) AS overall FROM c),
tree AS (
  SELECT host, template, string_split(template, '/') AS branch, n, bad, (SELECT max(len(segments)) FROM s) AS d FROM c
  UNION ALL
  SELECT host, template, CASE WHEN len(branch) >= d AND (own_n = 0 OR abs(own_bad::DOUBLE / own_n - rate) <= {NEAR}::DOUBLE * sqrt(rate * (1 - rate) / own_n)) THEN wild ELSE branch END, n, bad, d - 1
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, branch) AS own_n, sum(bad) OVER (PARTITION BY host, branch) AS own_bad,
               sum(bad) OVER (PARTITION BY host, wild)::DOUBLE / nullif(sum(n) OVER (PARTITION BY host, wild), 0) AS rate
        FROM (SELECT *, list_concat(branch[:d - 1], ['*'], branch[d + 1:]) AS wild FROM tree WHERE d > 0) x) y),
merged AS (SELECT host, branch, sum(n) AS bn, sum(bad) AS bb FROM tree WHERE d = 0 GROUP BY host, branch),
blocked AS (
  SELECT host, template FROM tree JOIN merged USING (host, branch), o
  WHERE d = 0 AND bn > 0 AND (bb + {WEIGHT}::DOUBLE * overall) / (bn + {WEIGHT}::DOUBLE) >= {MOST_BAD}::DOUBLE)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN k.template IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, p.template
FROM p LEFT JOIN blocked k USING (host, template)
"""


ORACLE = _oracle()
