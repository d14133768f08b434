"""Queries over the supplied tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.constants import KEYWORD_ADMISSION, VECTOR_ADMISSION, candidate_k
from lodestone.functions import text
from lodestone.operators import context, fusion, judge, lifecycle, metrics, traces, trigram, vector, workflow
from lodestone.plans import tables
from lodestone.plans.retrieve import retrieve
from lodestone.shared import shared_dir, stored
from lodestone.sources import chunkers, files, formats
from lodestone.streaming import folds, ingest, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SQL_CHUNKS = """chunks AS (
  SELECT doc_id * 100000 + chunk_index AS id, lang AS kb, doc_id AS document_id, chunk_index, content, source AS document_name FROM (
    SELECT doc_id, lang, source, unnest(c) AS content, CAST(unnest(range(0, len(c))) AS INTEGER) AS chunk_index FROM (
      SELECT doc_id, lang, source, list_filter(list_transform(
        list_filter(range(0, length(text), 450), lambda p: p = 0 OR p - 450 + 500 < length(text)),
        lambda p: regexp_replace(substr(text, CAST(p + 1 AS BIGINT), 500), '^[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g')), lambda c: c <> '') AS c
      FROM documents)))"""
SQL_KEY = r"""regexp_replace(regexp_replace(replace({}, chr(13) || chr(10), chr(10)), '[ \t]+(\n|\z)', '\1', 'g'), '^[\t\n\x0b\f\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\t\n\x0b\f\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"""
SQL_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
NOW = "2024-06-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("id % 20 = 0").withColumnRenamed("id", "query_id")


# ---- vector and keyword search


@query(f"SELECT b.vec_id AS id, round({SQL_COS}, 6) AS score, CAST(row_number() OVER (ORDER BY {SQL_COS} DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 0 QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """One query vector against all, top 10."""
    own = _vectors(spark, d)
    found = vector.top_k(own.where("id = 0").withColumnRenamed("id", "query_id"), own, 10, 64)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({SQL_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_COS} DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10")
def vector_topk_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return vector.top_k(_asked(spark, d), _vectors(spark, d), 10, 64).withColumn("score", F.round("score", 6))


@query(ORACLES["vector_topk_multi_query"])
def vector_topk_pivot_index(spark: SparkSession, d: str) -> DataFrame:
    """The same through the pivot index."""
    return vector.PivotIndex(_vectors(spark, d), 64).search(_asked(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.label AS model, b.vec_id AS id, {SQL_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
g AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, model ORDER BY score DESC, id) <= 20)
SELECT query_id, model, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM g QUALIFY rank <= 20""")
def vector_topk_grouped_merge(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each embedding model (label) in one pass, merged and cut again."""
    cut = candidate_k(5)
    both = vector.top_k(_asked(spark, d).drop("label"), _vectors(spark, d), cut, 64, "label").withColumn("model", F.col("group").cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    merged = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cut)
    return merged.select("query_id", "model", "id", F.round("score", 6).alias("score"), "rank")


SQL_MIRRORED = "list_cosine_similarity(CAST(CASE WHEN b.label % 2 = 0 THEN a.embedding ELSE list_reverse(a.embedding) END AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label % 2 AS model, {SQL_MIRRORED} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label NOT IN (3, 6)),
g AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, model ORDER BY score DESC, id) <= 20)
SELECT query_id, id, CASE model WHEN 0 THEN 'even' ELSE 'odd' END AS model, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM g QUALIFY rank <= 20""")
def vector_in_selected_bases(spark: SparkSession, d: str) -> DataFrame:
    """Bases (labels) of two models, base 3 not active and 6 not selected; each model has its own vector of a query (that of the odd ones is turned around)."""
    bases = _label_bases(spark, d).where("active").where("kb <> 6").select("kb", "model")
    shown = _vectors(spark, d).join(bases, F.col("label") == F.col("kb"))
    cut = candidate_k(5)
    found = vector.top_k(_by_model(spark, d).withColumnRenamed("model", "group"), shown, cut, 64, "model")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cut)
    return merged.select("query_id", "id", F.col("group").alias("model"), F.round("score", 6).alias("score"), "rank")


def _label_bases(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("label").alias("kb")).distinct().select("kb", F.when(F.col("kb") % 2 == 0, "even").otherwise("odd").alias("model"), (F.col("kb") != 3).alias("active"))


def _by_model(spark: SparkSession, d: str) -> DataFrame:
    """The query vectors as each model gives them."""
    own = _asked(spark, d).select("query_id", "embedding")
    return own.select("query_id", F.lit("even").alias("model"), "embedding").unionByName(own.select("query_id", F.lit("odd").alias("model"), F.reverse("embedding").alias("embedding")))


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({SQL_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_COS} DESC, b.vec_id) <= 20 AND {SQL_COS} >= {VECTOR_ADMISSION}")
def vector_admission_filter(spark: SparkSession, d: str) -> DataFrame:
    found = vector.top_k(_asked(spark, d), _vectors(spark, d), 20, 64)
    return found.where(fusion.admitted(F.col("score"), F.lit(None).cast("double"))).select("query_id", "id", F.round("score", 6).alias("score"))


def _two_paths(spark: SparkSession, d: str) -> DataFrame:
    """Vector candidates, and as second path the vectors of the query's label by id, scored 1 / (1 + n)."""
    v = vector.top_k(_asked(spark, d), _vectors(spark, d), 20, 64)
    first = _vectors(spark, d).select("id", "label").withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where("pos <= 20")
    k = _asked(spark, d).select("query_id", "label").join(first, "label")
    k = k.select("query_id", F.lit("keyword").alias("path"), "id", "pos", (1 / (1 + F.col("pos"))).alias("score"))
    return v.select("query_id", F.lit("vector").alias("path"), "id", F.col("rank").alias("pos"), "score").unionByName(k)


SQL_FUSED = f"""v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {SQL_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_COS} DESC, b.vec_id) AS pos FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY pos <= 20),
k AS (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS pos, 1.0::DOUBLE / (1 + pos) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0 QUALIFY pos <= 20),
f AS (SELECT query_id, id, coalesce(0.65::DOUBLE / (60 + v.pos), 0) + coalesce(0.35::DOUBLE / (60 + k.pos), 0) AS fusion, greatest(v.score, k.score) AS score, v.score AS vector_score, k.score AS keyword_score FROM v FULL JOIN k USING (query_id, id)),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, score DESC, id) AS INTEGER) AS pos FROM f)"""


@query(f"WITH {SQL_FUSED} SELECT query_id, id, pos, round(fusion, 9) AS fusion, round(score, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_two_paths(spark, d)).select("query_id", "id", "pos", F.round("fusion", 9).alias("fusion"), F.round("score", 6).alias("score"))


SQL_OK = f"(coalesce(vector_score >= {VECTOR_ADMISSION}, false) OR coalesce(keyword_score >= {KEYWORD_ADMISSION}, false))"


@query(f"WITH {SQL_FUSED} SELECT query_id, count(*) AS candidates, count(*) FILTER (vector_score < {VECTOR_ADMISSION}) AS vector_below, count(*) FILTER (keyword_score < {KEYWORD_ADMISSION}) AS keyword_below, count(*) FILTER ({SQL_OK}) AS admitted, count(*) FILTER (NOT {SQL_OK}) AS rejected FROM fused GROUP BY query_id")
def admission_stats(spark: SparkSession, d: str) -> DataFrame:
    return fusion.admission_stats(fusion.fuse(_two_paths(spark, d)))


@query(f"""WITH {SQL_FUSED}, c AS (SELECT query_id, id, pos, {SQL_KEY.format("coalesce(text, '')")} AS key FROM fused JOIN documents ON doc_id = id WHERE {SQL_OK}),
u AS (SELECT query_id, id, pos FROM c QUALIFY key = '' OR row_number() OVER (PARTITION BY query_id, key ORDER BY pos) = 1)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank FROM u QUALIFY rank <= 5""")
def fuse_admit_dedup_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ids stand for documents of the same number; those without one drop out."""
    docs = tables.load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    fused = fusion.fuse(_two_paths(spark, d)).join(docs, "id")
    return fusion.admit_dedup_top_k(fused, 5).select("query_id", "id", "rank")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


SQL_GRAMS = """SELECT DISTINCT id, substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM (SELECT id, w, unnest(range(1, length(w) + 2)) AS i FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ({})))"""


@query(f"""WITH {SQL_CHUNKS}, q AS ({SQL_GRAMS.format("SELECT item_id AS id, coalesce(text, '') AS t FROM benchmark")}), c AS ({SQL_GRAMS.format("SELECT id, content AS t FROM chunks")}), n AS (SELECT id, count(*) AS query_size FROM q GROUP BY id)
SELECT q.id AS query_id, c.id, count(*) AS common, any_value(query_size) AS query_size FROM q JOIN c USING (g) JOIN n ON n.id = q.id GROUP BY q.id, c.id HAVING 10 * count(*) >= 3 * any_value(query_size)""")
def keyword_prefilter_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Common trigrams of each item and chunk that pass the lossless prefilter."""
    return trigram.overlap(_questions(spark, d), tables.chunks(spark, d))


@query()
def keyword_word_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    return trigram.search(_questions(spark, d), tables.chunks(spark, d), 20)


@query()
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every benchmark item against all chunks, top 5 with neighbours."""
    embed = ingest.trigram_embedding(64)
    out = shared_dir(spark, "hybrid")
    pieces = tables.chunks(spark, d).repartition(spark.sparkContext.defaultParallelism)  # a page of text outweighs its bytes here
    chunks = stored(ingest.embed_chunks(pieces, embed), f"{out}/chunks")  # embedded once, read by column afterwards
    asked = stored(ingest.embed_chunks(_questions(spark, d), embed, "query"), f"{out}/asked")
    return retrieve(asked, chunks, 5, 64).select("query_id", "pos", "id", "neighbor_of", F.round("score", 6).alias("score"), "document_id", "chunk_index")


# ---- chunks, dedup, neighbours


@query(f"WITH {SQL_CHUNKS} SELECT document_id, chunk_index, content FROM chunks")
def chunk_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return tables.chunks(spark, d).select("document_id", "chunk_index", "content")


def _marked_up(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Documents with a heading, and lines as paragraphs; the tables have no markup of their own."""
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    marked = F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n\n"), body) if kind == "md" else body
    return tables.load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(kind).alias("file_type"), marked.alias("text"), F.lit(None).cast("int").alias("page_number"))


@query()
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk_documents(_marked_up(spark, d, "sentence"), 500, 50).select("document_id", "chunk_index", "content")


@query()
def chunk_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk_documents(_marked_up(spark, d, "txt"), 500, 50).select("document_id", "chunk_index", "content")


@query()
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk_documents(_marked_up(spark, d, "md"), 500, 50).select("document_id", "chunk_index", "content", "section_title")


@query()
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines as pages: no chunk crosses one."""
    docs = tables.load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("pdf").alias("file_type"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "text"))
    pages = docs.select("document_id", "file_type", "text", (F.col("p") + 1).alias("page_number"))
    return chunkers.chunk_documents(pages, 500, 50).select("document_id", "page_number", "chunk_index", "content")


@query(r"""WITH l AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)
SELECT doc_id AS document_id, 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text FROM l GROUP BY doc_id""")
def pdf_page_text(spark: SparkSession, d: str) -> DataFrame:
    """Glyph layer made of lines, one glyph each, read back as page text."""
    docs = tables.load(spark, d, "documents")
    glyphs = docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "s"))
    placed = glyphs.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0) - 10 * F.col("seq")).withColumn("w", F.length("s").cast("double"))
    return files.page_text(placed)


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'txt' WHEN p_partkey % 4 = 1 THEN 'md' WHEN p_partkey % 4 = 2 THEN 'pdf' END AS file_type FROM part")
def file_type_dispatch(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(F.lit(".txt"), F.lit(".md"), F.lit(".pdf"), F.lit(".TXT")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return tables.load(spark, d, "part").select("p_partkey", files.file_type(F.concat("p_name", suffix)).alias("file_type"))


@query(f"WITH {SQL_CHUNKS} SELECT kb, count(*) AS chunks FROM chunks GROUP BY kb")
def chunk_counts_by_kb(spark: SparkSession, d: str) -> DataFrame:
    return tables.chunks(spark, d).groupBy("kb").agg(F.count("*").alias("chunks"))


@query(f"WITH {SQL_CHUNKS} SELECT kb.lang AS kb, coalesce(n, 0) AS chunks FROM (SELECT DISTINCT lang FROM documents UNION SELECT 'none') kb LEFT JOIN (SELECT kb, count(*) AS n FROM chunks GROUP BY kb) c ON c.kb = kb.lang")
def kb_with_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge bases with the number of their published chunks, 0 without any."""
    kbs = tables.load(spark, d, "documents").select(F.col("lang").alias("kb")).distinct().union(spark.createDataFrame([("none",)], "kb string"))
    counts = tables.chunks(spark, d).where("is_published").groupBy("kb").agg(F.count("*").alias("n"))
    return kbs.join(counts, "kb", "left").select("kb", F.coalesce("n", F.lit(0)).alias("chunks"))


@query("SELECT label AS model, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 32 AS batch, vec_id AS id FROM embeddings")
def embed_batch_groups(spark: SparkSession, d: str) -> DataFrame:
    own = _vectors(spark, d).select(F.col("label").alias("model"), "id")
    return files.numbered(own, "id", ["model"]).select("model", F.floor((F.col("position") - 1) / 32).alias("batch"), "id")


@query("SELECT label AS batch, count(embedding) = count(*) AND min(len(embedding)) > 0 AND min(len(embedding)) = max(len(embedding)) AND min(len(embedding)) = 64 AS valid FROM embeddings GROUP BY label")
def embed_batch_validation(spark: SparkSession, d: str) -> DataFrame:
    own = _vectors(spark, d)
    sizes = own.groupBy("label").agg(F.count("*").alias("expected"))
    return ingest.batch_validity(own.join(sizes, "label").select(F.col("label").alias("batch"), "expected", "embedding"))


SQL_UNIQUE = f"SELECT lang, doc_id, {SQL_KEY.format('text')} AS key FROM documents"


@query(f"WITH k AS ({SQL_UNIQUE}) SELECT lang, doc_id FROM k QUALIFY key = '' OR row_number() OVER (PARTITION BY lang, key ORDER BY doc_id) = 1")
def exact_content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_of_content(tables.load(spark, d, "documents"), ["lang"], "text", "doc_id").select("lang", "doc_id")


@query(f"WITH k AS ({SQL_UNIQUE}), g AS (SELECT lang, key, count(*) AS n FROM k GROUP BY lang, key) SELECT lang, CAST(sum(CASE WHEN key <> '' THEN n - 1 ELSE 0 END) AS BIGINT) AS suppressed FROM g GROUP BY lang")
def dedup_suppressed_count(spark: SparkSession, d: str) -> DataFrame:
    return fusion.suppressed(tables.load(spark, d, "documents"), ["lang"], "text")


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Results of the query vectors: of the document at rank r (a vector stands for the document of its number) chunk r - 1, where it has one."""
    return _anchors_in(spark, d, tables.chunks(spark, d))


def _anchors_in(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    found = vector.top_k(_asked(spark, d), _vectors(spark, d), 20, 64).withColumnRenamed("id", "document_id")
    return found.withColumn("chunk_index", F.col("rank") - 1).join(chunks, ["document_id", "chunk_index"])


SQL_ANCHORS = f"""{SQL_CHUNKS}, found AS (SELECT a.vec_id AS query_id, b.vec_id AS document_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20),
anchors AS (SELECT query_id, id, document_id, chunk_index, content, rank FROM found JOIN chunks USING (document_id) WHERE chunk_index = rank - 1)"""


@query(f"WITH {SQL_ANCHORS} SELECT DISTINCT document_id, 1::BIGINT AS document_version, chunk_index FROM (SELECT document_id, unnest([chunk_index - 1, chunk_index + 1]) AS chunk_index FROM anchors) WHERE chunk_index >= 0")
def neighbor_requests(spark: SparkSession, d: str) -> DataFrame:
    return fusion.neighbor_requests(_anchors(spark, d))


@query(f"""WITH {SQL_ANCHORS},
w AS (SELECT query_id, id AS neighbor_of, rank, document_id, s AS side, chunk_index + CASE s WHEN 0 THEN -1 ELSE 1 END AS chunk_index FROM anchors, (VALUES (0), (1)) t(s)),
n AS (SELECT w.query_id, w.neighbor_of, w.rank, w.side, c.id, c.content FROM w JOIN chunks c USING (document_id, chunk_index) WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.query_id = w.query_id AND a.id = c.id) QUALIFY row_number() OVER (PARTITION BY w.query_id, c.id ORDER BY w.rank, w.side) = 1),
b AS (SELECT query_id, '' AS neighbor_of, rank, 0 AS side, id, content, 0 AS tier FROM anchors UNION ALL SELECT query_id, CAST(neighbor_of AS VARCHAR), rank, side, id, content, 1 FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, side) AS pos, {SQL_KEY.format("content")} AS key FROM b),
u AS (SELECT * FROM p QUALIFY key = '' OR row_number() OVER (PARTITION BY query_id, key ORDER BY pos) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS pos, id, neighbor_of FROM u""")
def neighbor_window(spark: SparkSession, d: str) -> DataFrame:
    chunks = tables.stored_chunks(spark, d)
    anchors = stored(_anchors_in(spark, d, chunks), f"{shared_dir(spark, 'neighbors')}/anchors")
    return fusion.with_neighbors(anchors, chunks).select("query_id", "pos", "id", "neighbor_of")


# ---- conversations and context


@query("""WITH m AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM m WHERE rn <= 200) SELECT conv_id, turn, CAST(running AS BIGINT) AS running FROM r WHERE running <= 1200""")
def history_truncation(spark: SparkSession, d: str) -> DataFrame:
    own = context.recent_history(tables.messages(spark, d), ["conv_id"], [F.col("turn").desc()], F.length("content"), 1200)
    return own.select("conv_id", "turn", "running")


@query("SELECT c_custkey AS conv_id, coalesce(text, '') AS preview FROM customer LEFT JOIN (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) ON conv_id = c_custkey")
def latest_message_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    last = tables.messages(spark, d).groupBy("conv_id").agg(F.max_by("content", "turn").alias("content"))
    ids = tables.load(spark, d, "customer").select(F.col("c_custkey").alias("conv_id"))
    return ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("content", F.lit("")).alias("preview"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR (o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey < 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS pos, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z_' || o_orderkey AS cursor FROM o""")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the newest rows before a cursor, turned to chronological order."""
    at, key = F.lit("1996-01-01").cast("timestamp"), 1000
    page = tables.load(spark, d, "orders").where((F.col("o_orderdate") < at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") < key))).orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(20)
    cursor = text.cursor(F.col("o_orderdate"), F.col("o_orderkey"))
    return page.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")).alias("pos"), cursor.alias("cursor"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders WHERE o_orderkey > 500")
def keyset_batch_scan(spark: SparkSession, d: str) -> DataFrame:
    """All batches of 1000 after key 500, until empty."""
    return files.keyset_batches(tables.load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("SELECT o_orderkey, o_orderdate AS created, CAST(o_orderkey AS VARCHAR) AS row_key FROM orders")
def cursor_decode(spark: SparkSession, d: str) -> DataFrame:
    """Every order's cursor written and read again."""
    own = tables.load(spark, d, "orders")
    at, key = text.cursor_parts(text.cursor(F.col("o_orderdate"), F.col("o_orderkey")))
    return own.select("o_orderkey", at.cast(own.schema["o_orderdate"].dataType).alias("created"), key.alias("row_key"))


SQL_ATTRIBUTE = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), chr(39), '&#39;'), chr(9), '&#x9;'), chr(10), '&#xA;'), chr(13), '&#xD;')"
HEAD = len('<source ref="" document="">\n\n</source>\n')


@query(f"""WITH RECURSIVE {SQL_CHUNKS},
it AS (SELECT document_id AS t, chunk_index AS pos, id, list_transform(string_split(content, ''), lambda c: CASE c WHEN '&' THEN 5 WHEN '<' THEN 4 WHEN '>' THEN 4 ELSE 1 END) AS w, {HEAD} + length({SQL_ATTRIBUTE.format("coalesce(document_name, CAST(document_id AS VARCHAR))")}) AS h FROM chunks WHERE chunk_index <= 4),
r(t, pos, id, room, taken, ref, cut, rendered) AS (
  SELECT DISTINCT t, -1, NULL::BIGINT, 1600::BIGINT, 0, NULL::VARCHAR, NULL::BOOLEAN, NULL::BIGINT FROM it
  UNION ALL
  SELECT t, pos, id, room - coalesce(size, 0), taken + (size IS NOT NULL)::INT, CASE WHEN size IS NOT NULL THEN 'S' || (taken + 1) END, big, size
  FROM (SELECT t, pos, id, room, taken, whole > room AS big,
          CASE WHEN whole <= room THEN whole WHEN whole <= 1600 OR head + 17 > room THEN NULL
               ELSE head + 17 + list_max(list_filter(list_transform(range(0, len(w) + 1), lambda n: coalesce(list_sum(list_slice(w, 1, n)), 0)), lambda s: s <= room - head - 17)) END AS size
        FROM (SELECT it.t, it.pos, it.id, it.w, r.room, r.taken, it.h + length('S' || (r.taken + 1)) AS head, it.h + length('S' || (r.taken + 1)) + list_sum(it.w) AS whole FROM r JOIN it ON it.t = r.t AND it.pos = r.pos + 1)))
SELECT t AS turn_id, ref, id, cut AS truncated, CAST(rendered AS BIGINT) AS rendered FROM r WHERE rendered IS NOT NULL""")
def evidence_budget_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per document as turn, its chunks in order under a budget of 1600 characters."""
    rows = tables.chunks(spark, d).select(F.col("document_id").alias("turn_id"), F.col("chunk_index").alias("pos"), "id", "document_id", F.col("document_name").alias("name"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("page"), "content", (1 / (1 + F.col("chunk_index"))).alias("score"))
    return context.select_evidence(rows, 1600).select("turn_id", "ref", "id", "truncated", "rendered")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with citations put in after the first words: some valid (S1, S3), some not."""
    return tables.load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" [S"), (F.col("turn") % 5).cast("string"), F.lit("] and [S3], [S"), ((F.col("conv_id") % 4) + 1).cast("string"), F.lit("]")).alias("content"))


SQL_ANSWERS = "answers AS (SELECT conv_id, turn, coalesce(text, '') || ' [S' || (turn % 5) || '] and [S3], [S' || ((conv_id % 4) + 1) || ']' AS content FROM conversations)"


@query(f"WITH {SQL_ANSWERS} SELECT conv_id, turn, array_to_string(regexp_extract_all(content, '\\[S([1-9][0-9]*)\\]', 1), ',') AS refs FROM answers")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("conv_id", "turn", F.array_join(F.regexp_extract_all("content", F.lit("\\[S([1-9][0-9]*)\\]"), F.lit(1)), ",").alias("refs"))


@query(f"""WITH {SQL_ANSWERS}, p AS (SELECT conv_id, turn, content, regexp_extract_all(content, '\\[S([1-9][0-9]*)\\]', 1) AS r FROM answers)
SELECT conv_id, turn, regexp_replace(content, '\\[S([2456789]|[1-9][0-9]+)\\]', '', 'g') AS cleaned, CAST(len(list_filter(r, lambda x: x NOT IN ('1', '3'))) AS INTEGER) AS invalid,
array_to_string(list_filter(['S1', 'S3'], lambda x: list_contains(r, substr(x, 2))), ',') AS refs_sorted FROM p""")
def citation_normalize(spark: SparkSession, d: str) -> DataFrame:
    cleaned, valid, invalid = text.citations(F.col("content"), F.array(F.lit("S1"), F.lit("S3")))
    return _answers(spark, d).select("conv_id", "turn", cleaned.alias("cleaned"), invalid.alias("invalid"), F.array_join(F.array_sort(valid), ",").alias("refs_sorted"))


@query(f"""WITH {SQL_ANSWERS}, r AS (SELECT conv_id, turn, 'S' || n AS ref, i FROM (SELECT conv_id, turn, unnest(x) AS n, unnest(range(1, len(x) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(content, '\\[S([1-9][0-9]*)\\]', 1) AS x FROM answers)))
SELECT conv_id, turn, ref, CAST(min(i) AS INTEGER) AS first_at, CAST(substr(ref, 2) AS INTEGER) AS number FROM r WHERE ref IN ('S1', 'S3') GROUP BY conv_id, turn, ref""")
def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Valid refs of each answer joined with the evidence they name, by first occurrence."""
    evidence = spark.createDataFrame([("S1", 1), ("S3", 3)], "ref string, n int")
    found = F.transform(F.regexp_extract_all("content", F.lit("\\[S([1-9][0-9]*)\\]"), F.lit(1)), lambda n: F.concat(F.lit("S"), n))
    refs = _answers(spark, d).select("conv_id", "turn", F.posexplode(found).alias("i", "ref")).groupBy("conv_id", "turn", "ref").agg((F.min("i") + 1).alias("first_at"))
    return refs.join(evidence, "ref").select("conv_id", "turn", "ref", "first_at", text.ref_number(F.col("ref")).alias("number"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(600 * turn AS INTEGER) END AS ctx, length(coalesce(text, '')) AS n FROM conversations),
f AS (SELECT *, CASE WHEN ctx IS NULL THEN 4000 ELSE greatest(0, ctx - 1000) END * 4 - (100 + 2 * 60 * 4 + n) AS fixed FROM c)
SELECT conv_id, turn, CAST(fixed AS BIGINT) AS fixed, CASE WHEN fixed < 0 THEN 'over_budget' ELSE 'ok' END AS status, CAST(greatest(0, least(8000, fixed) - 41 - 50) AS BIGINT) AS evidence_cap, CAST(greatest(0, fixed - 300) AS BIGINT) AS history FROM f""")
def context_budget_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    own = tables.messages(spark, d).select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, (600 * F.col("turn")).cast("int")).alias("context_tokens"), F.lit(100).alias("system_len"), F.lit(2).alias("tools"), F.length("content").alias("latest_len"), F.lit(50).alias("rules_len"), F.lit(300).alias("evidence_len"))
    out = context.budgets(own)
    return out.select("conv_id", "turn", F.col("fixed").cast("long").alias("fixed"), "status", F.col("evidence_cap").cast("long").alias("evidence_cap"), F.col("history").cast("long").alias("history"))


@query("SELECT conv_id, CAST(sum(length(coalesce(text, ''))) + 2 * 60 * 4 AS BIGINT) AS estimate FROM conversations GROUP BY conv_id")
def request_length(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).groupBy("conv_id").agg((F.sum(F.length("content")) + 2 * 60 * 4).alias("estimate"))


@query(f"WITH {SQL_CHUNKS} SELECT id, '<source ref=\"S' || (chunk_index + 1) || '\" document=\"' || document_name || '\">' || chr(10) || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</source>' || chr(10) AS rendered FROM chunks")
def source_render(spark: SparkSession, d: str) -> DataFrame:
    null = F.lit(None)
    own = tables.chunks(spark, d)
    tag = text.source_tag(F.concat(F.lit("S"), (F.col("chunk_index") + 1).cast("string")), text.shown_name(F.col("document_name"), F.col("document_id")), null.cast("string"), null.cast("int"), F.col("content"))
    return own.select("id", tag.alias("rendered"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;'), chr(9), '&#x9;'), chr(10), '&#xA;'), chr(13), '&#xD;') AS escaped FROM documents""")
def xml_escape(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "documents").select("doc_id", text.escape_attribute(F.col("text")).alias("escaped"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def sha256_hash(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "documents").select("doc_id", text.token_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, text FROM documents")
def encrypt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit("0123456789abcdef0123456789abcdef")
    return tables.load(spark, d, "documents").select("doc_id", text.decrypt(text.encrypt(F.col("text"), key), key).alias("text"))


# ---- evaluation


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per query vector: expected are the vectors of its label (none for label 0); results the ten nearest."""
    own, asked = _vectors(spark, d), _asked(spark, d)
    cases = asked.select(F.col("query_id").alias("name"), (F.col("label") != 0).alias("configured"), F.col("label").alias("wanted"))
    nearest = stored(vector.top_k(asked, own, 10, 64), f"{shared_dir(spark, 'cases')}/nearest")  # at most ten rows a case; searched once for all uses
    found = nearest.where("id <> query_id").join(own.select("id", "label"), "id").select(F.col("query_id").alias("name"), "rank", F.col("id").alias("document_id"), "label")
    found = found.join(cases.select("name", "wanted"), "name").select("name", "rank", "document_id", (F.col("label") == F.col("wanted")).alias("expected"))
    return found, cases.drop("wanted")


SQL_CASES = f"""r AS (SELECT a.vec_id AS name, a.label AS own, b.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10),
m AS (SELECT name, any_value(own) <> 0 AS configured, count(*) FILTER (id <> name) AS result_count, min(rank) FILTER (id <> name AND label = own AND own <> 0) AS first FROM r GROUP BY name),
metrics AS (SELECT name, result_count, CASE WHEN configured THEN coalesce(first <= 1, false)::INT::DOUBLE END AS hit1, CASE WHEN configured THEN coalesce(first <= 3, false)::INT::DOUBLE END AS hit3, CASE WHEN configured THEN (first IS NOT NULL)::INT::DOUBLE END AS hit, CASE WHEN configured THEN coalesce(1::DOUBLE / first, 0) END AS mrr FROM m)"""


@query(f"WITH {SQL_CASES} SELECT name, result_count, hit1, hit3, hit, round(mrr, 9) AS mrr FROM metrics")
def eval_case_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.matched_metrics(*_cases(spark, d)).withColumn("mrr", F.round("mrr", 9))


SQL_DUPLICATES = f"""dup AS (SELECT name, sum(n - 1) AS duplicates FROM (SELECT name, key, count(*) AS n FROM (SELECT name, {SQL_KEY.format("coalesce(text, '')")} AS key FROM r JOIN documents ON doc_id = id WHERE id <> name) WHERE key <> '' GROUP BY name, key) GROUP BY name)"""


@query(f"""WITH {SQL_CASES}, {SQL_DUPLICATES} SELECT round(avg(hit1), 9) AS hit1, round(avg(hit3), 9) AS hit3, round(avg(mrr), 9) AS mrr, round(avg(rate), 9) AS unique_rate, coalesce(avg(hit1) >= 1 AND avg(hit3) >= 1 AND avg(mrr) >= 1 AND avg(rate) >= 1, false) AS passed
FROM (SELECT metrics.*, CASE WHEN result_count = 0 THEN 1.0::DOUBLE ELSE 1 - coalesce(duplicates, 0)::DOUBLE / result_count END AS rate FROM metrics LEFT JOIN dup USING (name))""")
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates are results of a case whose document (that of the vector's number) says the same as another's."""
    found, cases = _cases(spark, d)
    texts = tables.load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    counted = fusion.suppressed(found.join(texts, "document_id"), ["name"]).withColumnRenamed("suppressed", "duplicates")
    own = metrics.matched_metrics(found, cases).join(counted, "name", "left").fillna(0, ["duplicates"])
    return metrics.gate(own).select(*(F.round(c, 9).alias(c) for c in ("hit1", "hit3", "mrr", "unique_rate")), "passed")


@query(f"WITH k AS ({SQL_UNIQUE}), g AS (SELECT lang, key, count(*) AS n FROM k GROUP BY lang, key) SELECT lang, round(1 - sum(CASE WHEN key <> '' THEN n - 1 ELSE 0 END)::DOUBLE / sum(n), 9) AS unique_rate FROM g GROUP BY lang")
def content_unique_rate(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    return fusion.suppressed(docs, ["lang"], "text").join(sizes, "lang").select("lang", F.round(1 - F.col("suppressed") / F.col("n"), 9).alias("unique_rate"))


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores of all labels, and a baseline that lacks the toxic ones of good quality."""
    own = tables.load(spark, d, "labels").select(F.col("doc_id").alias("name"), (F.col("quality") * 4 + 1).alias("score"), "toxic", "quality")
    return own.select("name", "score"), own.where("not (toxic = 1 and quality = 1)").select("name", (5 - F.col("toxic") * 3).alias("score"))


@query("""WITH b AS (SELECT doc_id AS name, 5 - toxic * 3 AS base FROM labels WHERE NOT (toxic = 1 AND quality = 1))
SELECT doc_id AS name, quality * 4 + 1 AS score, base AS base_score, CASE WHEN base IS NULL THEN '—' WHEN quality * 4 + 1 = base THEN '=' ELSE printf('%+.2f', (quality * 4 + 1 - base)::DOUBLE) END AS cell FROM labels LEFT JOIN b ON b.name = doc_id""")
def baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    current, base = _runs(spark, d)
    return metrics.compare(current, base).select("name", "score", "base_score", text.delta(F.col("score"), F.col("base_score")).alias("cell"))


@query("SELECT coalesce(max((5 - toxic * 3) - (quality * 4 + 1) >= 2), false) AS regressed FROM labels WHERE NOT (toxic = 1 AND quality = 1)")
def regression_flag(spark: SparkSession, d: str) -> DataFrame:
    return metrics.regressed(*_runs(spark, d), 2)


# ---- catalogue


@query("SELECT n_name, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 AND n_regionkey <> 0")
def active_models_by_capability(spark: SparkSession, d: str) -> DataFrame:
    """Models (suppliers) of providers (nations), both active."""
    providers = tables.load(spark, d, "nation").where("n_regionkey <> 0")
    return tables.load(spark, d, "supplier").where("s_acctbal > 0").join(providers, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_name")


@query("SELECT l_orderkey, string_agg(p, ',' ORDER BY p) AS parts FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS p FROM lineitem) GROUP BY l_orderkey")
def association_lists(spark: SparkSession, d: str) -> DataFrame:
    own = tables.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("p"))
    return own.select("l_orderkey", F.array_join(F.array_sort("p"), ",").alias("parts"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS orders, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey")
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.min("l_orderkey").alias("first_order"))


@query("SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_totalprice > 100000) AS large FROM orders")
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 10 OR o_orderpriority = '1-URGENT'")
def owner_or_admin_filter(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "orders").where((F.col("o_custkey") == 10) | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building'")
def collated_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Equality without regard to case and accents."""
    return tables.load(spark, d, "customer").where(F.collate("c_mktsegment", "UNICODE_CI_AI") == F.lit("Building")).select("c_custkey", "c_name")


# ---- mutations


@query("""WITH a AS (SELECT p_partkey % 40 AS server, p_name AS tool, min(p_partkey) AS id, min(p_type) AS d FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL), b AS (SELECT p_partkey % 40 AS server, p_name AS tool, max(p_brand) AS d FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL)
SELECT server, tool, a.id, coalesce(b.d, a.d) AS description, b.d IS NOT NULL AS active FROM a FULL JOIN b USING (server, tool)""")
def upsert_and_deactivate(spark: SparkSession, d: str) -> DataFrame:
    part = tables.load(spark, d, "part").withColumn("server", F.col("p_partkey") % 40).withColumnRenamed("p_name", "tool")
    old = part.where("p_partkey % 3 <> 0").groupBy("server", "tool").agg(F.min("p_partkey").alias("id"), F.min("p_type").alias("description"))
    remote = part.where("p_partkey % 2 = 0").groupBy("server", "tool").agg(F.max("p_brand").alias("description"))
    return lifecycle.upsert_tools(old, remote)


@query("SELECT p_partkey, p_name || ' old' AS v FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    part = tables.load(spark, d, "part")
    return lifecycle.insert_or_ignore(part.where("p_partkey % 3 = 0").select("p_partkey", F.concat("p_name", F.lit(" old")).alias("v")), part.select("p_partkey", F.col("p_name").alias("v")), "p_partkey")


@query("SELECT l_orderkey AS agent, l_partkey AS kb FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, -1 FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey")
def replace_all(spark: SparkSession, d: str) -> DataFrame:
    links = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("agent"), F.col("l_partkey").alias("kb"))
    return lifecycle.replace_all(links, links.where("agent % 5 = 0").select("agent", F.lit(-1).cast("bigint").alias("kb")).distinct(), "agent")


@query("SELECT l_orderkey AS document_id, l_linenumber % 2 AS document_version, l_linenumber AS chunk_index, l_orderkey % 2 = 0 OR l_linenumber % 2 = 0 AS is_published FROM lineitem WHERE l_orderkey % 2 <> 0 OR l_linenumber % 2 = 1")
def publish_version(spark: SparkSession, d: str) -> DataFrame:
    """Even documents publish version 1; version 0 is the one published before."""
    own = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 2).alias("document_version"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_linenumber") % 2 == 0).alias("is_published"))
    return lifecycle.publish(own, own.where("document_id % 2 = 0").select("document_id", F.lit(1).alias("version")).distinct())


def _states(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*(F.lit(s) for s in ("pending", "processing", "publishing", "ready"))), (F.col("event_id") % 4 + 1).cast("int"))
    return tables.load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("version"), state.alias("status"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("lease"), F.col("ts").alias("updated_at"))


SQL_STATES = "s AS (SELECT event_id AS id, event_id % 3 AS version, ['pending', 'processing', 'publishing', 'ready'][event_id % 4 + 1] AS status, CASE WHEN event_id % 4 <> 0 THEN ts END AS lease, ts AS updated_at FROM events)"


@query(f"""WITH {SQL_STATES}, e AS (SELECT event_id AS id, event_id % 2 AS version, ['claim', 'publishing', 'ready', 'fail'][event_id % 5 % 4 + 1] AS event FROM events),
j AS (SELECT s.*, event, coalesce((event = 'claim' AND status IN ('pending', 'failed')) OR (event = 'publishing' AND status = 'processing') OR (event = 'ready' AND status = 'publishing') OR (event = 'fail' AND status = 'processing'), false) AS applied FROM s LEFT JOIN e USING (id, version))
SELECT id, version, CASE WHEN applied THEN CASE event WHEN 'claim' THEN 'processing' WHEN 'fail' THEN 'failed' ELSE event END ELSE status END AS status, applied FROM j""")
def cas_transition(spark: SparkSession, d: str) -> DataFrame:
    events = tables.load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 2).alias("version"), F.element_at(F.array(*(F.lit(s) for s in ("claim", "publishing", "ready", "fail"))), (F.col("event_id") % 5 % 4 + 1).cast("int")).alias("event"))
    return lifecycle.apply_transitions(_states(spark, d), events, F.lit(NOW).cast("timestamp")).drop("lease")


@query(f"""WITH {SQL_STATES}, now AS (SELECT max(ts) AS now FROM events),
a AS (SELECT id, version, status, CASE WHEN status = 'processing' AND lease < now THEN 'requeue_new_version' WHEN status = 'publishing' AND lease < now THEN 'republish' WHEN status = 'pending' AND updated_at < now - INTERVAL 2 MINUTE THEN 'requeue' END AS action FROM s, now)
SELECT id, action, version + (action = 'requeue_new_version')::INT AS version, CASE WHEN action = 'requeue_new_version' THEN 'pending' ELSE status END AS status FROM a WHERE action IS NOT NULL""")
def reconcile_stale(spark: SparkSession, d: str) -> DataFrame:
    now = tables.load(spark, d, "events").agg(F.max("ts").cast("string").alias("t")).first().t
    return lifecycle.reconcile(_states(spark, d), F.lit(now).cast("timestamp"))


SQL_TOKENS = "t AS (SELECT event_id AS id, ts + INTERVAL 7 DAY AS expires_at, CASE WHEN event_id % 3 = 0 THEN ts END AS revoked_at, user_id, (SELECT max(ts) FROM events) AS now FROM events)"


def _tokens(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    events = tables.load(spark, d, "events")
    now = events.agg(F.max("ts").cast("string").alias("t")).first().t
    return events.select(F.col("event_id").alias("id"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("revoked_at"), "user_id"), now


@query(f"WITH {SQL_TOKENS} SELECT id FROM t WHERE NOT (expires_at < now OR coalesce(revoked_at < now - INTERVAL 1 DAY, false))")
def expired_token_purge(spark: SparkSession, d: str) -> DataFrame:
    tokens, now = _tokens(spark, d)
    at = F.lit(now).cast("timestamp")
    return lifecycle.purge_tokens(tokens, at, at - F.expr("INTERVAL 1 DAY")).select("id")


@query(f"WITH {SQL_TOKENS} SELECT id, CASE WHEN user_id % 10 = 0 THEN coalesce(revoked_at, now) ELSE revoked_at END AS revoked_at FROM t")
def revoke_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens, now = _tokens(spark, d)
    return lifecycle.revoke(tokens, F.col("user_id") % 10 == 0, F.lit(now).cast("timestamp")).select("id", "revoked_at")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey = 3 AND l_linenumber = 1)")
def delete_version(spark: SparkSession, d: str) -> DataFrame:
    own = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("document_version"))
    return lifecycle.delete_document(own, 3, 1).select(F.col("document_id").alias("l_orderkey"), F.col("document_version").alias("l_linenumber"))


# ---- JSON, streams, limiter


@query("""SELECT event_id, '{' || array_to_string(list_filter([CASE WHEN event_id % 5 <> 0 THEN '"count":' || (event_id % 5) END, CASE WHEN event_type <> '' THEN '"type":' || to_json(event_type) END, CASE WHEN user_id <> 0 THEN '"user":' || user_id END, '"zero":"0"'], lambda x: x IS NOT NULL), ',') || '}' AS attrs FROM events""")
def span_attrs_clean(spark: SparkSession, d: str) -> DataFrame:
    strings = F.create_map(F.lit("type"), F.col("event_type"), F.lit("empty"), F.lit(""), F.lit("zero"), F.lit("0"))
    integers = F.create_map(F.lit("user"), F.col("user_id").cast("long"), F.lit("count"), (F.col("event_id") % 5).cast("long"))
    return tables.load(spark, d, "events").select("event_id", text.clean_attrs(strings, integers).alias("attrs"))


@query("""WITH s AS (SELECT event_id AS id, user_id AS trace_id, ts, event_type AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS root FROM events WHERE user_id IS NOT NULL)
SELECT s.id, s.trace_id, CASE WHEN root THEN NULL ELSE first_value(s.id) OVER w END AS parent_id, CASE WHEN root THEN NULL ELSE first_value(s.name) OVER w END AS parent_name,
       CASE WHEN root THEN count(*) OVER (PARTITION BY trace_id) - 1 ELSE 0 END AS children FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY ts, id)""")
def trace_tree(spark: SparkSession, d: str) -> DataFrame:
    """Events as spans: a user's first one is the root of the trace, the others are its children."""
    own = tables.load(spark, d, "events").where("user_id is not null").select(F.col("event_id").alias("id"), F.col("user_id").alias("trace_id"), "ts", F.col("event_type").alias("name"))
    roots = own.groupBy("trace_id").agg(F.min_by("id", F.struct("ts", "id")).alias("root_id"))
    spans = own.join(roots, "trace_id").withColumn("parent_id", F.when(F.col("id") != F.col("root_id"), F.col("root_id")))
    return lifecycle.span_tree(spans)


@query("SELECT l_orderkey AS message_id, string_agg('S' || l_linenumber || '=' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS refs FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY l_orderkey")
def citations_by_message(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the asked messages in one pass, ordered by the number of their ref."""
    rows = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("ref"), F.col("l_partkey").alias("chunk_id"), F.lit(0.5).alias("score"))
    asked = rows.where("message_id % 20 = 0").select("message_id")
    shown = F.array_join(F.transform("citations", lambda c: F.concat(c["ref"], F.lit("="), c["chunk_id"].cast("string"))), ",")
    return lifecycle.citations_of(asked, rows).select("message_id", shown.alias("refs"))


@query("""SELECT kb, model FROM (SELECT DISTINCT lang AS kb, CASE WHEN length(lang) % 2 = 0 AND lang < 'f' THEN 'a' ELSE 'b' END AS model FROM documents WHERE lang IS NOT NULL AND lang <> 'de')""")
def active_kb_models(spark: SparkSession, d: str) -> DataFrame:
    """Selected knowledge bases that exist and are active, with their model; the others are skipped."""
    bases = _bases(spark, d)
    grouped = bases.where("active").groupBy("model").agg(F.collect_list("kb").alias("kbs"))
    return grouped.select(F.explode("kbs").alias("kb"), "model")


def _bases(spark: SparkSession, d: str) -> DataFrame:
    """A knowledge base per language, of two models; ``de`` is not active."""
    langs = tables.load(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("kb")).distinct()
    model = F.when((F.length("kb") % 2 == 0) & (F.col("kb") < "f"), "a").otherwise("b")
    return langs.select("kb", model.alias("model"), (F.col("kb") != "de").alias("active"))


@query("""SELECT conv_id, turn, CASE WHEN octet_length(encode(t)) <= 500 THEN t ELSE substr(t, 1, list_max(list_filter(range(0, 501), lambda k: octet_length(encode(substr(t, 1, k))) <= 500))) || '...(截断)' END AS short FROM (SELECT conv_id, turn, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM conversations)""")
def judge_cut(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a judge gets them."""
    return tables.messages(spark, d).select("conv_id", "turn", text.judge_cut(F.col("content")).alias("short"))


@query("SELECT event_id, json_valid(props) AS valid, len(json_keys(props)) AS keys FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    props = tables.load(spark, d, "events").select("event_id", "props")
    return props.select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.size(F.json_object_keys("props")).cast("long").alias("keys"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).select(F.col("conv_id").alias("turn"), F.col("turn").alias("seq"), F.when(F.col("turn") % 3 != 0, F.col("turn") % 3).cast("int").alias("index"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), F.col("turn").cast("string"))).otherwise("").alias("id"), F.col("role").alias("name"), F.col("content").alias("args"))


@query("""WITH x AS (SELECT conv_id AS t, turn AS seq, CAST(turn % 3 AS INTEGER) AS i, CASE WHEN turn % 2 = 0 THEN 'c' || turn ELSE '' END AS id, role AS name, coalesce(text, '') AS args FROM conversations),
s AS (SELECT t, CAST(unnest(range(0, max(i) + 1)) AS INTEGER) AS i FROM x GROUP BY t),
g AS (SELECT t, i, max_by(id, seq) FILTER (id <> '') AS id, max_by(name, seq) FILTER (name <> '') AS name, string_agg(args, '' ORDER BY seq) AS args FROM x GROUP BY t, i)
SELECT t AS turn, i AS index, coalesce(id, '') AS id, coalesce(name, '') AS name, coalesce(args, '') AS args FROM s LEFT JOIN g USING (t, i)""")
def tool_call_delta_merge(spark: SparkSession, d: str) -> DataFrame:
    return folds.merge_tool_calls(_deltas(spark, d))


@query("""WITH x AS (SELECT conv_id AS t, turn AS seq, coalesce(text, '') AS s, turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 2 = 0 AS final FROM conversations)
SELECT t AS turn, CASE WHEN bool_or(final) THEN max(s) FILTER (final) ELSE string_agg(s, '' ORDER BY seq) END AS text, CASE WHEN bool_or(final) THEN 'ok' ELSE 'failed' END AS status FROM x GROUP BY t""")
def stream_concat(spark: SparkSession, d: str) -> DataFrame:
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    own = tables.messages(spark, d).withColumn("last", last)
    kind = F.when((F.col("turn") == F.col("last")) & (F.col("conv_id") % 2 == 0), "final").otherwise("delta")
    return folds.drain(own.select(F.col("conv_id").alias("turn"), F.col("turn").alias("seq"), kind.alias("kind"), F.col("content").alias("text")))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w(user_id, event_id, n, start, hits) AS (SELECT user_id, event_id, n, ts, 1 FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts >= w.start + INTERVAL 15 MINUTE THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL 15 MINUTE THEN 1 ELSE w.hits + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, hits <= 10 AS allowed FROM w""")
def rate_limit_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return folds.rate_limit(tables.load(spark, d, "events")).select("user_id", "event_id", "allowed")


@query("""WITH e AS (SELECT user_id AS key, event_id AS seq, value > 20 AS failed FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - row_number() OVER (PARTITION BY key, failed ORDER BY seq) AS grp FROM e)
SELECT key, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS failures FROM g WHERE failed GROUP BY key, grp HAVING count(*) >= 5""")
def consecutive_failures(spark: SparkSession, d: str) -> DataFrame:
    return folds.failure_runs(tables.load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("failed")))


# ---- workflow


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2) % 25 AS dst FROM nation), r AS (SELECT 1 AS node UNION SELECT dst FROM e JOIN r ON src = node) SELECT CAST(node AS VARCHAR) AS node FROM r")
def workflow_reachability(spark: SparkSession, d: str) -> DataFrame:
    nation = tables.load(spark, d, "nation")
    edges = nation.select(F.col("n_nationkey").cast("string").alias("src"), ((F.col("n_nationkey") * 2) % 25).cast("string").alias("dst"))
    return workflow.reachable(edges, "1")


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    """A definition an order, of its lines as steps; by the order's key it is right or has one fault."""
    lines = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    own = lines.withColumn("fault", F.col("name") % 8).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 1)))
    own = own.where("fault <> 6 or seq > 0")  # no start
    first, last = F.col("seq") == 0, F.col("seq") == F.col("n") + 1
    step = lambda k: F.concat(F.lit("s"), k.cast("string"))
    follow = F.when(last, F.when(F.col("fault") == 1, "s0").otherwise("")).when((F.col("fault") == 2) & (F.col("seq") == F.col("n")), "nowhere").when((F.col("fault") == 3) & (F.col("seq") == F.col("n")), "s1").when((F.col("fault") == 4) & (F.col("seq") == F.col("n")), "").when((F.col("fault") == 5) & first, step(F.col("n") + 1)).otherwise(step(F.col("seq") + 1))
    kind = F.when(first, "start").when(last, "end").otherwise("llm_call")
    none = F.lit("")
    steps = own.select("name", "seq", F.when((F.col("fault") == 7) & last, "s1").otherwise(step(F.col("seq"))).alias("id"), kind.alias("type"), F.create_map(F.lit("prompt"), F.lit("{{.Prev}}")).alias("config"), follow.alias("next"), none.alias("next_if_true"), none.alias("next_if_false"))
    return workflow.definitions_of(steps)


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS name, CASE l_orderkey % 8 WHEN 1 THEN 'end_has_outgoing' WHEN 2 THEN 'dangling_edge' WHEN 3 THEN 'cycle_detected' WHEN 4 THEN 'dead_end' WHEN 5 THEN 'unreachable_step' WHEN 6 THEN 'missing_start_step' WHEN 7 THEN 'duplicate_step_id' ELSE 'ok' END AS code FROM lineitem GROUP BY l_orderkey""")
def workflow_validate(spark: SparkSession, d: str) -> DataFrame:
    """Every order's definition, judged where its row lies."""
    return workflow.validity(_definitions(spark, d))


@query("""SELECT conv_id || '-' || turn AS run, CASE WHEN role = 'tool' THEN 'failed' ELSE 'succeeded' END AS status,
CASE WHEN role = 'tool' THEN '' WHEN role = 'user' AND turn <> 2 THEN '<' || upper(role || ':' || turn) || '>' ELSE 'false' END AS output,
CASE WHEN role = 'tool' THEN 's0=succeeded,s1=failed' WHEN role = 'user' AND turn <> 2 THEN 's0=succeeded,s1=succeeded,s2=succeeded,s3=succeeded' ELSE 's0=succeeded,s1=succeeded,s3=succeeded' END AS log FROM conversations""")
def workflow_runs(spark: SparkSession, d: str) -> DataFrame:
    """A conditional workflow run for every message; a tool's message has a condition that is no truth value and fails."""
    rows = tables.messages(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("run"), F.concat_ws(":", "role", "turn").alias("given"), "role")
    test = F.when(F.col("role") == "tool", '"no" + "truth"').otherwise('input startsWith "user" && !(input endsWith ":2")')
    steps = [
        F.struct(F.lit("s0").alias("id"), F.lit("start").alias("type"), F.lit("s1").alias("next")),
        F.struct(F.lit("s1").alias("id"), F.lit("conditional").alias("type"), F.struct(test.alias("expression")).alias("config"), F.lit("s2").alias("next_if_true"), F.lit("s3").alias("next_if_false")),
        F.struct(F.lit("s2").alias("id"), F.lit("llm_call").alias("type"), F.struct(F.lit("{{.Input}}").alias("prompt")).alias("config"), F.lit("s3").alias("next")),
        F.struct(F.lit("s3").alias("id"), F.lit("end").alias("type")),
    ]
    definition = F.concat(F.lit('{"steps":['), F.concat_ws(",", *(F.to_json(x) for x in steps)), F.lit("]}"))
    done = workflow.runs(rows.select("run", definition.alias("definition"), "given"), {"llm_call": lambda config, prev: f"<{config['prompt'].upper()}>"})
    return done.select("run", "status", "output", F.array_join(F.transform("steps", lambda x: F.concat(x["step"], F.lit("="), x["status"])), ",").alias("log"))


@query("SELECT conv_id, turn, 'In: ' || coalesce(text, '') || ' | by ' || role || ' #' || turn AS rendered FROM conversations")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    column = workflow.render_column("In: {{.Input}} | by {{.Prev}} #{{.Steps.s1}}", F.col("content"), F.col("role"), {"s1": F.col("turn").cast("string")})
    return tables.messages(spark, d).select("conv_id", "turn", column.alias("rendered"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND turn <> 2 THEN 'true_branch' ELSE 'false_branch' END AS branch FROM conversations")
def conditional_branch(spark: SparkSession, d: str) -> DataFrame:
    """A condition as a column: the branch each row takes."""
    taken = (F.col("role") == "user") & (F.col("turn") != 2)
    return tables.messages(spark, d).select("conv_id", "turn", F.when(taken, "true_branch").otherwise("false_branch").alias("branch"))


# ---- chunk store, document states, breakers, spans, judge, files


def _two_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as version 1, those of even number in a second version as well, without their first 100 characters."""
    docs = tables.load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("txt").alias("file_type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("int").alias("page_number"))
    second = docs.where("document_id % 2 = 0").withColumn("text", F.substring("text", 101, 1_000_000_000)).withColumn("version", F.lit(2).cast("long"))
    return docs.withColumn("version", F.lit(1).cast("long")).unionByName(second)


def _windows(rows: DataFrame) -> DataFrame:
    """Fixed windows of 500 with 50 carried over."""
    own = rows.select("document_id", "document_version", "page_number", F.posexplode(text.fixed_windows(F.col("text"), 500, 50)).alias("chunk_index", "content"))
    return own.withColumn("section_title", F.lit(None).cast("string"))


SQL_VERSIONS = SQL_CHUNKS.replace("lang AS kb, ", "").replace("source AS document_name", "version").replace("doc_id, lang, source, unnest", "doc_id, version, unnest").replace("SELECT doc_id, lang, source, list_filter", "SELECT doc_id, version, list_filter").replace("FROM documents)))", "FROM docs)))")
SQL_DOCS = "docs AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 2 = 0 THEN substr(coalesce(text, ''), 101) ELSE coalesce(text, '') END AS text FROM documents)"


@query(f"""WITH {SQL_DOCS}, {SQL_VERSIONS}, n AS (SELECT document_id, count(*) AS n, bool_or(content LIKE '%@%') AS refused FROM chunks GROUP BY document_id)
SELECT doc_id AS document_id, version AS document_version, CASE WHEN n IS NULL OR refused THEN 'failed' ELSE 'ready' END AS status, CASE WHEN n IS NULL THEN 'no chunk' WHEN refused THEN 'model: refused' END AS reason, CASE WHEN refused THEN 0 ELSE coalesce(n, 0) END AS chunk_count FROM docs LEFT JOIN n ON document_id = doc_id
UNION ALL SELECT doc_id, 1, 'superseded', NULL, 0 FROM documents WHERE doc_id % 2 = 0""")
def ingest_states(spark: SparkSession, d: str) -> DataFrame:
    """States after a batch with two versions of documents and a model that refuses texts with an address."""
    return _ingested(spark, d).documents().select("document_id", F.col("document_version").cast("int").alias("document_version"), "status", "reason", "chunk_count")


@query(f"""WITH {SQL_DOCS}, {SQL_VERSIONS}, good AS (SELECT document_id FROM chunks GROUP BY document_id HAVING NOT bool_or(content LIKE '%@%'))
SELECT document_id, CAST(version AS BIGINT) AS document_version, chunk_index, content FROM chunks JOIN good USING (document_id)""")
def ingest_visible(spark: SparkSession, d: str) -> DataFrame:
    """What readers see after the same batch, given twice."""
    return _ingested(spark, d).visible().select("document_id", "document_version", "chunk_index", "content")


def _ingested(spark: SparkSession, d: str) -> store.ChunkStore:
    embed = ingest.trigram_embedding(8)

    def picky(texts: list[str]) -> list[list[float]]:
        if any("@" in t for t in texts):
            raise ValueError("refused")
        return embed(texts)

    own = store.ChunkStore(spark, f"{shared_dir(spark, 'chunk-store')}/store")
    for _ in range(2):
        own.ingest(_two_versions(spark, d), picky, "first", _windows)
    return own


def _document_events(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in folds.DocumentStates.UPDATES))
    own = tables.load(spark, d, "events").where("user_id is not null and ts is not null")
    kind = F.element_at(names, (F.col("event_id") * 5 % 9 + 1).cast("int"))
    return own.select(F.col("user_id").alias("id"), "event_id", folds.micros("ts").alias("at"), kind.alias("event"), F.when(F.col("event_id") % 7 == 0, F.lit(1).cast("long")).alias("version"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS id, event_id, ts, ['claim', 'renew_processing', 'publishing', 'renew_publishing', 'ready', 'fail', 'retry', 'reclaim', 'recover'][event_id * 5 % 9 + 1] AS event, CASE WHEN event_id % 7 = 0 THEN 1 END AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w(id, event_id, n, applied, status, version, lease) AS (
  SELECT DISTINCT id, -1::BIGINT, 0::BIGINT, false, 'pending', 1::BIGINT, NULL::TIMESTAMP FROM e
  UNION ALL
  SELECT id, event_id, n, ok, CASE WHEN ok THEN CASE event WHEN 'claim' THEN 'processing' WHEN 'publishing' THEN 'publishing' WHEN 'ready' THEN 'ready' WHEN 'fail' THEN 'failed' WHEN 'retry' THEN 'pending' WHEN 'reclaim' THEN 'pending' ELSE status END ELSE status END,
         CASE WHEN ok AND event IN ('retry', 'reclaim') THEN version + 1 ELSE version END,
         CASE WHEN NOT ok THEN lease WHEN event IN ('ready', 'fail', 'retry', 'reclaim') THEN NULL ELSE ts + INTERVAL 600 MINUTE END
  FROM (SELECT e.id, e.event_id, e.n, e.ts, e.event, w.status, w.version, w.lease,
               coalesce(e.asked, w.version) = w.version AND CASE e.event WHEN 'claim' THEN w.status IN ('pending', 'failed') WHEN 'retry' THEN w.status IN ('pending', 'failed')
                 WHEN 'reclaim' THEN w.status = 'processing' AND coalesce(w.lease < e.ts, false) WHEN 'recover' THEN w.status = 'publishing' AND coalesce(w.lease < e.ts, false)
                 WHEN 'ready' THEN w.status = 'publishing' WHEN 'renew_publishing' THEN w.status = 'publishing' ELSE w.status = 'processing' END AS ok
        FROM w JOIN e ON e.id = w.id AND e.n = w.n + 1))
SELECT id, event_id, applied, status, version, lease FROM w WHERE n > 0""")
def document_states(spark: SparkSession, d: str) -> DataFrame:
    """All updates of documents in order, with the lease (ten hours, as events are that far apart)."""
    done = folds.fold_rows(_document_events(spark, d), "id", ["at", "event_id"], folds.DocumentStates(600))
    return done.select("id", "event_id", "applied", "status", "version", F.timestamp_micros("lease").cast(tables.load(spark, d, "events").schema["ts"].dataType).alias("lease"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, value > 20 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w(key, event_id, n, shown, allowed, status, failures, opened) AS (
  SELECT DISTINCT key, -1::BIGINT, 0::BIGINT, '', false, 'closed', 0::BIGINT, NULL::TIMESTAMP FROM e
  UNION ALL
  SELECT key, event_id, n, CASE WHEN turned THEN 'open' WHEN status = 'open' THEN 'half-open' ELSE 'closed' END, NOT turned,
         CASE WHEN turned THEN 'open' WHEN failed AND (status = 'open' OR failures + 1 >= 5) THEN 'open' ELSE 'closed' END,
         CASE WHEN turned THEN failures WHEN failed THEN failures + 1 ELSE 0 END,
         CASE WHEN turned THEN opened WHEN failed AND (status = 'open' OR failures + 1 >= 5) THEN ts END
  FROM (SELECT e.key, e.event_id, e.n, e.ts, coalesce(e.failed, false) AS failed, w.status, w.failures, w.opened, w.status = 'open' AND e.ts <= w.opened + INTERVAL 12 HOUR AS turned FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1))
SELECT key, event_id, shown AS status, allowed, failures FROM w WHERE n > 0""")
def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """Calls of users through a breaker that opens for twelve hours."""
    calls = tables.load(spark, d, "events").where("user_id is not null and ts is not null").select(F.col("user_id").alias("key"), "event_id", folds.micros("ts").alias("at"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("failed"))
    return folds.fold_rows(calls, "key", ["at", "event_id"], folds.Breaker(seconds=12 * 3600)).drop("at")


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
s AS (SELECT e.id, e.trace_id, CASE WHEN e.n = 1 THEN NULL WHEN e.n = 7 THEN -1 WHEN e.n = 5 AND y.id IS NOT NULL THEN y.id ELSE p.id END AS parent_id
      FROM e LEFT JOIN e p ON p.trace_id = e.trace_id AND p.n = e.n // 2 LEFT JOIN e y ON y.trace_id = e.trace_id AND y.n = 11),
w(id, trace_id, status, depth, root_id, path) AS (
  SELECT id, trace_id, CASE WHEN parent_id IS NULL THEN 'ok' ELSE 'orphan' END, 0, id, CAST(id AS VARCHAR) FROM s WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM s p WHERE p.trace_id = s.trace_id AND p.id = s.parent_id)
  UNION ALL SELECT s.id, s.trace_id, w.status, w.depth + 1, w.root_id, w.path || '/' || s.id FROM w JOIN s ON s.trace_id = w.trace_id AND s.parent_id = w.id)
SELECT s.id, s.trace_id, coalesce(w.status, 'cycle') AS status, CAST(w.depth AS INTEGER) AS depth, w.root_id, w.path FROM s LEFT JOIN w USING (id, trace_id)""")
def trace_paths(spark: SparkSession, d: str) -> DataFrame:
    """Spans of six levels and more: the n-th of a user's events lies below the n/2-th; the seventh has lost its parent, and the fifth is below the eleventh, which is below the fifth."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = tables.load(spark, d, "events").where("user_id is not null").select(F.col("event_id").alias("id"), F.col("user_id").alias("trace_id"), F.row_number().over(order).alias("n"))
    ids = own.select("trace_id", F.col("n").alias("m"), F.col("id").alias("parent"))
    above = own.withColumn("m", F.floor(F.col("n") / 2)).join(ids, ["trace_id", "m"], "left").drop("m")
    eleventh = ids.where("m = 11").select("trace_id", F.col("parent").alias("eleventh"))
    above = above.join(eleventh, "trace_id", "left")
    parent = F.when(F.col("n") == 1, F.lit(None).cast("long")).when(F.col("n") == 7, -1).when((F.col("n") == 5) & F.col("eleventh").isNotNull(), F.col("eleventh")).otherwise(F.col("parent"))
    done = traces.span_paths(above.select("id", "trace_id", parent.alias("parent_id")))
    return done.select("id", "trace_id", "status", "depth", "root_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


SQL_W = {k: v.replace("'", "''") for k, v in vars(judge.Wording()).items()}


@query(f"""WITH c AS (SELECT conv_id AS name, list(coalesce(text, '') ORDER BY turn) FILTER (role = 'user') AS turns, string_agg(CASE WHEN role <> 'user' THEN coalesce(text, '') END, ' ' ORDER BY turn) AS reply FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id AS name, string_agg('- [' || role || '] t' || turn || ' status=ok' || chr(10), '' ORDER BY turn) AS steps FROM conversations WHERE role <> 'user' GROUP BY conv_id),
t AS (SELECT name, reply, CASE WHEN coalesce(len(turns), 0) = 0 THEN ['none'] ELSE turns END AS turns FROM c)
SELECT name, '{SQL_W["opening"]}' || chr(10) || chr(10) || CASE WHEN len(turns) = 1 THEN '{SQL_W["question"]}' || turns[1] || chr(10) || chr(10)
  ELSE '{SQL_W["turns"]}' || chr(10) || array_to_string(list_transform(turns, lambda x, i: '{SQL_W["turn"]}' || i || CASE WHEN i = len(turns) THEN '{SQL_W["last"]}' ELSE '' END || ': ' || x || chr(10)), '') || chr(10) END
  || '{SQL_W["rubric"]}be exact' || chr(10) || chr(10) || CASE WHEN name % 2 = 0 THEN '{SQL_W["expected"]}' || chr(10) || '- fact ' || name || chr(10) || '- more' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN name % 3 = 0 THEN '{SQL_W["forbidden"]}' || chr(10) || '- lie' || chr(10) || chr(10) ELSE '' END
  || '{SQL_W["reply"]}' || coalesce(reply, '') || chr(10) || chr(10) || '{SQL_W["spans"]}' || chr(10) || coalesce(steps, '') AS prompt FROM t LEFT JOIN p USING (name)""")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A case a conversation: its users' turns, what the others said as reply, and a span for each of these."""
    own = tables.messages(spark, d).withColumn("name", F.col("conv_id"))
    user = F.col("role") == "user"
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("turn", "content")))), lambda x: x["content"])
    cases = own.groupBy("name").agg(listed(user).alias("turns"), F.array_join(listed(~user), " ").alias("reply"))
    none = F.array().cast("array<string>")
    cases = cases.select("name", F.lit("none").alias("prompt"), "turns", F.lit("be exact").alias("rubric"), "reply", F.when(F.col("name") % 2 == 0, F.array(F.concat(F.lit("fact "), F.col("name").cast("string")), F.lit("more"))).otherwise(none).alias("expected_facts"), F.when(F.col("name") % 3 == 0, F.array(F.lit("lie"))).otherwise(none).alias("forbidden_facts"))
    spans = own.where(~user).select("name", F.col("turn").alias("started_at"), F.col("turn").alias("id"), F.col("role").alias("kind"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("label"), F.lit("ok").alias("status"), F.lit(" ").alias("input"), F.lit(None).cast("string").alias("output"))
    return judge.prompts(cases.drop("reply"), cases.select("name", "reply"), spans)


@query("""SELECT event_id AS name, CASE WHEN event_id % 6 IN (0, 1) THEN CAST(event_id % 5 + 1 AS INTEGER) END AS score, CASE WHEN event_id % 6 IN (0, 1) THEN coalesce(event_type, '') END AS reasoning,
CASE event_id % 6 WHEN 2 THEN 'score out of range' WHEN 3 THEN 'no whole score' WHEN 4 THEN 'no JSON object' WHEN 5 THEN 'no JSON object' END AS problem FROM events""")
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a judge, plain and fenced, out of range, without a whole score, a list, and cut off."""
    own = tables.load(spark, d, "events").select(F.col("event_id").alias("name"), (F.col("event_id") % 5 + 1).alias("n"), F.coalesce("event_type", F.lit("")).alias("why"))
    good = F.to_json(F.struct(F.col("n").alias("score"), F.col("why").alias("reasoning")))
    case = F.col("name") % 6
    answer = F.when(case == 0, good).when(case == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```\n"))).when(case == 2, F.to_json(F.struct((F.col("n") + 5).alias("score")))).when(case == 3, F.to_json(F.struct((F.col("n") / 7).alias("score")))).when(case == 4, F.concat(F.lit("["), good, F.lit("]"))).otherwise(F.substring(good, 1, 9))
    return judge.verdicts(own.select("name", answer.alias("answer")))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
w AS (SELECT doc_id, n, array_to_string(list_filter(string_split(line, ' '), lambda x: x <> ''), ' ') AS line FROM l)
SELECT doc_id AS document_id, n // 20 + 1 AS page, string_agg(line, chr(10) ORDER BY n) FILTER (line <> '') AS text FROM w GROUP BY doc_id, n // 20""")
def glyph_file_pages(spark: SparkSession, d: str) -> DataFrame:
    """Glyph layers written as files, words as glyphs with gaps between, twenty lines a page, and read back through the data source; pages without glyphs stay.

    A page lies in its document's row and is read back as a row, so neither texts nor glyphs are
    shuffled; only documents of an id that is there more than once meet, page by page, before they
    are written.
    """
    docs, out = tables.load(spark, d, "documents").select("doc_id", "text"), shared_dir(spark, "glyphs")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a page of text outweighs its bytes here
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    number = lambda v: v.cast("long").cast("string")
    # [x,y,w,s]: s and the last bracket are those of a JSON list of the word alone
    glyph = lambda w, x, y: F.concat(F.lit("["), number(x), y, number(F.length(w)), F.lit(","), F.substr(F.to_json(F.array(w)), F.lit(2)))

    def pages(own: DataFrame) -> DataFrame:
        lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
        cut = F.transform(F.array(lines), lambda ls: F.transform(F.sequence(F.lit(1), F.size(ls), F.lit(20)), lambda n: F.slice(ls, n, 20)))[0]
        # a line's words are split once and lie in columns as wide as its longest word and the gap
        words = F.transform("lines", lambda line, n: F.struct(F.filter(F.split(line, " "), lambda x: x != "").alias("words"), F.concat(F.lit(","), number(-10 * (20 * F.col("at") + n)), F.lit(",")).alias("y")))
        laid = F.transform(words, lambda l: F.struct(l["words"].alias("words"), l["y"].alias("y"), (F.array_max(F.transform(l["words"], F.length)) + 2).cast("long").alias("width")))
        placed = F.flatten(F.transform(laid, lambda l: F.transform(l["words"], lambda w, i: glyph(w, i * l["width"], l["y"]))))
        return own.select("doc_id", F.posexplode(cut).alias("at", "lines")).select("doc_id", (F.col("at") + 1).alias("page"), placed.alias("glyphs"))

    many = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), f"{out}/again")
    if many.isEmpty():
        own = pages(docs)
    else:
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        own = pages(docs.join(many, same, "left_anti")).unionByName(pages(docs.join(many, same, "left_semi")).groupBy("doc_id", "page").agg(F.flatten(F.collect_list("glyphs")).alias("glyphs")))
    row = F.concat(F.lit('{"document_id":'), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(',"page":'), F.col("page").cast("string"), F.lit(',"glyphs":['), F.array_join("glyphs", ","), F.lit("]}"))
    # a file is read as a whole by a task: so many pages are some 10 MB of JSON
    own.select(row.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 1000).text(f"{out}/files")
    read = formats.read(spark, formats.GlyphPageSource, f"{out}/files", 1)
    return read.select("document_id", F.col("page").cast("long").alias("page"), F.nullif(files.text_of_glyphs(F.col("glyphs")), F.lit("")).alias("text"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_orderkey % 5 = 0 AND l_linenumber = 1 AS broken FROM lineitem),
ok AS (SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM c WHERE l_orderkey = o_orderkey AND broken))
SELECT id AS message_id, count(l_orderkey) AS citations, coalesce(sum(l_partkey), 0)::BIGINT AS chunks FROM ok LEFT JOIN c ON l_orderkey = id GROUP BY id""")
def message_log(spark: SparkSession, d: str) -> DataFrame:
    """Messages (orders) and their citations (lines) appended together in one commit, given twice; a message with a broken citation leaves neither."""
    messages = tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))
    quote = F.when(~((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 1)), "q")
    citations = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("ref"), F.col("l_partkey").cast("long").alias("chunk_id"), quote.alias("quote"), F.lit(0.5).alias("score"))
    log = store.TableSet(spark, f"{shared_dir(spark, 'messages')}/log", {"messages": "id long, content string", "citations": "message_id long, ref string, chunk_id long, quote string, score decimal(5,4)"})
    ok, rows = lifecycle.with_citations(messages, citations)
    for _ in range(2):
        log.append("turn-1", {"messages": ok, "citations": rows})
    counts = log.read("citations").groupBy(F.col("message_id").alias("id")).agg(F.count("*").alias("citations"), F.sum("chunk_id").alias("chunks"))
    return log.read("messages").join(counts, "id", "left").select(F.col("id").alias("message_id"), F.coalesce("citations", F.lit(0).cast("long")).alias("citations"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per query vector: results, cases that want a citation where the number is divisible by 40, and as cited documents the results of odd rank."""
    found, cases = _cases(spark, d)
    cited = found.where("rank % 2 = 1").select("name", "document_id", "expected")
    return found, cases.withColumn("require_citation", F.col("name") % 40 == 0), cited


@query(f"""WITH {SQL_CASES}, c AS (SELECT name, count(*) AS n, bool_or(label = own AND own <> 0) AS named FROM r WHERE id <> name AND rank % 2 = 1 GROUP BY name)
SELECT name, CASE WHEN name % 40 = 0 THEN coalesce(n, 0) > 0 END AS citation_met, CASE WHEN configured THEN coalesce(named, false) END AS expected_cited,
'{{"name":' || name || ',"results":' || result_count || CASE WHEN configured THEN ',"hit1":' || CAST(hit1 AS INTEGER) || ',"hit3":' || CAST(hit3 AS INTEGER) ELSE '' END || '}}' AS report
FROM metrics LEFT JOIN c USING (name) JOIN (SELECT name, configured FROM m) USING (name)""")
def eval_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whether a case's citations are there and name an expected document, and the case as a line of a JSON report."""
    found, cases, cited = _judged(spark, d)
    own = metrics.matched_metrics(found, cases.select("name", "configured")).join(metrics.cited_metrics(cited, cases), "name")
    line = F.struct("name", F.col("result_count").alias("results"), F.col("hit1").cast("int").alias("hit1"), F.col("hit3").cast("int").alias("hit3"))
    return own.select("name", "citation_met", "expected_cited", metrics.report_line(line).alias("report"))


SQL_EDGE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
def _sql_trimmed(array: str) -> str:
    return f"list_filter(list_transform({array}, lambda x: regexp_replace(x, '^{SQL_EDGE}|{SQL_EDGE}$', '', 'g')), lambda x: x <> '')"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, {_sql_trimmed(r"string_split_regex(replace(t, chr(13) || chr(10), chr(10)), '\n[\t\n\f\r ]*\n+')")} AS paragraphs,
        {_sql_trimmed("list_append(regexp_extract_all(t, '[^。！？.!?]*[。！？.!?]+'), regexp_extract(t, '[^。！？.!?]*$'))")} AS sentences, right(t, 40) AS tail FROM d)
SELECT doc_id, array_to_string(paragraphs, chr(30)) AS paragraphs, array_to_string(sentences, chr(30)) AS sentences, tail FROM p""")
def text_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, sentences and the last characters of every document, by column functions."""
    own = tables.load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    joined = lambda c: F.array_join(c, "\x1e")
    return own.select("doc_id", joined(text.paragraphs(F.col("t"))).alias("paragraphs"), joined(text.sentences(F.col("t"))).alias("sentences"), text.tail(F.col("t"), 40).alias("tail"))
