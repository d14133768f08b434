"""Merkle manifest of a dataset: nodes in a table, proofs by coordinate lookup.

A leaf is the hash of a row; the leaves of a source, in order of doc_id, are hashed in runs of
``FAN`` until one node is left, its subroot; the subroots, in order of source, make a tree of
the same kind over all sources.  A node has the coordinates (tree, level, idx).

* Positions come from a range partitioning by (source, doc_id): rows of one stretch are
  numbered there and stretches are added up, so a source of any size is dealt out.
* Each level is one grouping by the parent's coordinates, written to the shared folder.
* A proof needs the coordinates of siblings, which follow from the leaf's index and the number
  of leaves alone.  The leaves of a run share all of them (but for its own), so the run explodes
  them once, joins the node table, and orders and concatenates what it finds; each leaf then
  folds its own hash up to the root.  Nodes of upper levels are asked for by many runs and lie
  there in several copies, one for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, stored, table

#: Nodes of a run, its logarithm, and about how many runs may ask for one copy of a node.
FAN, FAN_BITS, ASKING = 16, 4, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*columns: Column) -> Column:
    """Hex SHA-256 of the columns: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    said = (c.cast("string") for c in columns)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)), 256)


def _hex(hashes: Column) -> Column:
    """Concatenated hex text of the hashes in an array of structs."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.hex(x["hash"]))), "")


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves: the number of k with FAN ** k < n."""
    return sum((F.when(n > F.lit(FAN**k), 1).otherwise(0) for k in range(63 // FAN_BITS + 1)), F.lit(0))


def _up(idx: Column, levels: Column) -> Column:
    """The index of the ancestor so many levels up."""
    return F.call_function("shiftright", idx, (levels * FAN_BITS).cast("int"))


def _copies(level: Column) -> Column:
    """Copies of a node of this level: about FAN ** level runs ask for it."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.pow(F.lit(float(FAN)), level.cast("double")) / ASKING))


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``idx`` (from 0 in the order of ``order`` within ``group``), ``n`` (rows of the group) and ``tree`` (the group's number in order).

    ``rows`` must be a written table.  Stretches are those of a range partitioning, so neither a
    large group nor many equal rows meet in one task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, group, *order, "tie").withColumn("stretch", F.spark_partition_id())
    dealt = stored(dealt, f"{out}/stretches")
    counts = stored(dealt.groupBy(group, "stretch").agg(F.count("*").alias("rows")), f"{out}/stretch-counts")  # groups + stretches rows
    before = Window.partitionBy(group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # a stretch begins with the first of its groups: groups that begin in earlier stretches come before it
    begins = counts.groupBy(group).agg(F.min("stretch").alias("first"), F.sum("rows").alias("n"))
    starts = begins.withColumn("nth", F.row_number().over(Window.partitionBy("first").orderBy(group)))
    firsts = starts.groupBy("first").agg(F.count("*").alias("groups"))  # at most one row a stretch
    firsts = firsts.withColumn("earlier", F.coalesce(F.sum("groups").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    trees = starts.join(firsts, "first").select(group, "n", (F.col("earlier") + F.col("nth") - 1).alias("tree"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows").join(trees, group)
    offsets = stored(offsets, f"{out}/offsets")
    own = F.row_number().over(Window.partitionBy(group, "stretch").orderBy(*order, "tie"))
    return dealt.withColumn("own", own).join(offsets, [group, "stretch"]).withColumn("idx", F.col("offset") + F.col("own") - 1).drop("own", "offset", "stretch", "tie")


def forest(leaves: DataFrame, out: str) -> DataFrame:
    """The node table ``tree, level, idx, n, size, hash`` over written ``leaves`` (tree, idx, size, hash): n nodes on the level, size leaves in the tree."""
    nodes = leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("size").alias("n"), "size", "hash")
    levels, most = [stored(nodes, f"{out}/level-0")], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("idx", "hash")))  # at most FAN
        up = levels[-1].where("n > 1").groupBy("tree", (F.col("level") + 1).alias("level"), _up(F.col("idx"), F.lit(1)).alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), "size")
        levels.append(stored(up.agg(F.unhex(F.sha2(_hex(run), 256)).alias("hash")), f"{out}/level-{len(levels)}"))
        most = -(-most // FAN)
    return leaves.sparkSession.read.schema(levels[0].schema).parquet(*(f"{out}/level-{k}" for k in range(len(levels))))


def runs(nodes: DataFrame) -> DataFrame:
    """``tree, run, size, members, path`` for each run of leaves.

    ``members`` are the run's leaves (idx, hash) where it has more than one level above; ``path``
    has for each level from 1 to the last the concatenated hashes to the left and right.
    """
    asking = nodes.where(f"level = 0 and idx % {FAN} = 0").select("tree", _up(F.col("idx"), F.lit(1)).alias("run"), "size", _depth(F.col("size")).alias("depth"))
    level, run = F.col("level"), F.col("run")
    at = asking.where("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    at = at.withColumn("above", F.when(level == 0, run).otherwise(_up(run, level)))  # the coordinate of the siblings' parent
    at = at.withColumn("own", F.when(level == 0, F.lit(-1).cast("long")).otherwise(_up(run, level - 1)))
    last = F.ceil(F.col("size") / F.pow(F.lit(float(FAN)), level.cast("double"))) - 1
    wanted = F.explode(F.sequence(F.col("above") * FAN, F.least(F.col("above") * FAN + FAN - 1, last)))
    wanted = at.select("tree", "run", "level", "own", wanted.alias("idx")).where("idx <> own").withColumn("salt", F.pmod(run, _copies(level)))
    offered = nodes.where("n > 1").select("tree", "level", "idx", "hash", F.explode(F.sequence(F.lit(0).cast("long"), _copies(level) - 1)).alias("salt"))
    met = wanted.join(offered, ["tree", "level", "idx", "salt"])
    found = met.groupBy("tree", "run").agg(F.sort_array(F.collect_list(F.struct("level", "idx", "own", "hash"))).alias("found"))  # at most FAN a level

    def side(k: Column, left: bool) -> Column:
        return _hex(F.filter("found", lambda x: (x["level"] == k) & ((x["idx"] < x["own"]) if left else (x["idx"] > x["own"]))))

    path = F.when(F.col("depth") > 1, F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right"))))
    members = F.transform(F.filter("found", lambda x: x["level"] == 0), lambda x: F.struct(x["idx"].alias("idx"), x["hash"].alias("hash")))
    none = F.array().cast("array<struct<left:string,right:string>>")
    return asking.join(found, ["tree", "run"], "left").select("tree", "run", "size", members.alias("members"), F.coalesce(path, none).alias("path"))


def own_path(idx: Column) -> Column:
    """All levels' left and right texts for the leaf ``idx`` of a row of ``runs``; empty in a tree of one leaf."""
    def others(test) -> Column:
        return _hex(F.filter("members", lambda x: test(x["idx"])))

    first = F.struct(others(lambda i: i < idx).alias("left"), others(lambda i: i > idx).alias("right"))
    return F.when(F.col("size") > 1, F.concat(F.array(first), F.col("path"))).otherwise(F.col("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def manifest(docs: DataFrame, out: str | None = None) -> tuple[DataFrame, DataFrame, str | None]:
    """Written tables of leaves and of nodes (tree -1: that over all sources), and the root, None for an empty table.

    Leaves: ``doc_id, source, leaf, changed, tree, idx, n``; changed is the leaf with the text's
    A-Z in lower case where 5 divides the crc32 of doc_id, else null.
    """
    out = out or shared_dir(docs.sparkSession, "merkle")
    doc_id = F.col("doc_id").cast("long")
    rest = [F.col(c) for c in ("source", "lang", "n_chars")]
    changed = F.when(F.crc32(doc_id.cast("string")) % 5 == 0, digest(doc_id, *rest, F.translate("text", UPPER, LOWER)))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null first, then by bytes
    leaves = docs.select(doc_id.alias("doc_id"), "source", key.alias("key"), digest(doc_id, *rest, F.col("text")).alias("leaf"), changed.alias("changed"))
    leaves = stored(leaves, f"{out}/hashes")
    leaves = stored(numbered(leaves, "key", ["doc_id", "leaf"], out).drop("key"), f"{out}/leaves")
    nodes = forest(leaves.select("tree", "idx", F.col("n").alias("size"), F.unhex("leaf").alias("hash")), f"{out}/nodes")
    trees = leaves.agg(F.max("tree")).first()[0]
    if trees is None:
        return leaves, nodes, None
    tops = nodes.where("n = 1").select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees + 1).cast("long").alias("size"), "hash")
    top = forest(tops, f"{out}/top")
    root = top.where("n = 1").select(F.lower(F.hex("hash"))).first()[0]  # one row
    return leaves, nodes.unionByName(top), root


def proofs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``leaves`` with ``subroot`` and ``path``, the texts left and right of it on each level up to the root.

    Any part of the leaves can be given; the nodes must be those of ``manifest``.
    """
    top, own = nodes.where("tree = -1"), nodes.where("tree >= 0")
    subroots = own.where("n = 1").select(F.col("tree").alias("idx"), F.col("size").alias("leaves"), F.lower(F.hex("hash")).alias("subroot"))
    subroots = subroots.withColumn("run", _up(F.col("idx"), F.lit(1))).join(runs(top).drop("tree"), "run")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("leaves") / (FAN * ASKING))))
    subroots = subroots.select(F.col("idx").alias("tree"), "leaves", "subroot", own_path(F.col("idx")).alias("over"), copies.alias("salt"))
    salted = runs(own).withColumn("salt", F.pmod(F.col("run"), F.floor(F.col("size") / (FAN * ASKING)) + 1))
    full = salted.join(subroots, ["tree", "salt"]).drop("salt", "leaves")
    joined = leaves.withColumn("run", _up(F.col("idx"), F.lit(1))).join(full, ["tree", "run"])
    return joined.withColumn("path", F.concat(own_path(F.col("idx")), "over")).drop("run", "size", "members", "over")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


def verified(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Null columns are hashed as ``-``, a null source is a source of its own and comes first, null
    doc_ids come first in their source and are never tampered with.  Rows of one doc_id are
    ordered by leaf; equal rows have equal leaves and places of their own, so their proofs differ
    only where their runs do.  Empty and very long texts are hashed whole.  Columns other than
    doc_id, source, lang, n_chars and text are ignored.  An empty table gives no rows.
    """
    leaves, nodes, root = manifest(docs)
    found = proofs(leaves, nodes)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, crc.tampered,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents LEFT JOIN (
    WITH RECURSIVE ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
    step(doc_id, i, c) AS (
      SELECT doc_id, 0, CAST(4294967295 AS BIGINT) FROM ids
      UNION ALL
      SELECT doc_id, i + 1,
             list_reduce(list_prepend(xor(c, ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1))), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                         lambda acc, bit: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END)
      FROM step WHERE i < length(CAST(doc_id AS VARCHAR)))
    SELECT doc_id AS crc_id, xor(c, 4294967295) % 5 = 0 AS tampered FROM step WHERE i = length(CAST(doc_id AS VARCHAR))) crc ON crc_id = doc_id),
h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM d),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM h),
nodes(tree, level, idx, n, hash) AS (
  SELECT tree, 0, idx, n, leaf FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16),
subs AS (SELECT tree AS idx, hash, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, idx, n, hash) AS (
  SELECT 0, idx, n, hash FROM subs
  UNION ALL
  SELECT level + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 16),
steps AS (
  SELECT tree, level, idx, string_agg(CASE WHEN o < idx THEN oh END, '' ORDER BY o) AS lft, string_agg(CASE WHEN o > idx THEN oh END, '' ORDER BY o) AS rgt
  FROM (SELECT a.tree, a.level, a.idx, b.idx AS o, b.hash AS oh FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1) GROUP BY tree, level, idx),
topsteps AS (
  SELECT level, idx, string_agg(CASE WHEN o < idx THEN oh END, '' ORDER BY o) AS lft, string_agg(CASE WHEN o > idx THEN oh END, '' ORDER BY o) AS rgt
  FROM (SELECT a.level, a.idx, b.idx AS o, b.hash AS oh FROM tops a JOIN tops b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1) GROUP BY level, idx),
up(tree, leafidx, level, idx, acc, proof) AS (
  SELECT tree, idx, 0, idx, coalesce(changed, leaf), '' FROM l
  UNION ALL
  SELECT up.tree, leafidx, up.level + 1, up.idx // 16, sha256(coalesce(lft, '') || acc || coalesce(rgt, '')), proof || coalesce(lft, '') || coalesce(rgt, '')
  FROM up JOIN steps s ON s.tree = up.tree AND s.level = up.level AND s.idx = up.idx),
topup(tree, leafidx, level, idx, acc, proof) AS (
  SELECT tree, leafidx, 0, tree, acc, proof FROM (SELECT *, row_number() OVER (PARTITION BY tree, leafidx ORDER BY level DESC) AS k FROM up) WHERE k = 1
  UNION ALL
  SELECT t.tree, leafidx, t.level + 1, t.idx // 16, sha256(coalesce(lft, '') || acc || coalesce(rgt, '')), proof || coalesce(lft, '') || coalesce(rgt, '')
  FROM topup t JOIN topsteps s ON s.level = t.level AND s.idx = t.idx),
done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, leafidx ORDER BY level DESC) AS k FROM topup) WHERE k = 1)
SELECT l.doc_id, l.leaf, subs.hash AS subroot, (SELECT hash FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, acc AS folded_root,
       acc = (SELECT hash FROM tops WHERE n = 1) AS verified
FROM l JOIN done ON done.tree = l.tree AND done.leafidx = l.idx JOIN subs ON subs.idx = l.tree
"""
