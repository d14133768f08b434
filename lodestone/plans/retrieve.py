"""The retrieval query: two searches, fusion, admission, dedup, top-k, neighbours, dedup, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.constants import candidate_k, clamp_top_k
from lodestone.operators import fusion, trigram, vector
from lodestone.shared import shared_dir, stored


def retrieve(queries: DataFrame, chunks: DataFrame, top_k: int, dim: int, neighbors: bool = True) -> DataFrame:
    """``query_id, query, embedding`` over chunks ``id, document_id, document_version, chunk_index, content, embedding, is_published``.

    Returns ordered rows per query: ``pos, id, score, neighbor_of`` (empty for anchors) and the
    chunk's coordinates and content.  Contents are joined to candidates only, never carried
    through ranking.  Queries with empty text find nothing.
    """
    top_k = clamp_top_k(top_k)
    asked = queries.where("query <> ''")
    shown = chunks.where("is_published")
    found = vector.top_k(asked.select("query_id", "embedding"), shown.select("id", "embedding"), candidate_k(top_k), dim)
    return _combine(asked, shown, found, top_k, neighbors)


def retrieve_in(asked: DataFrame, chunks: DataFrame, bases: DataFrame, selected: list[str] | None, top_k: int, dims: dict[str, int], neighbors: bool = True) -> DataFrame:
    """``retrieve`` in the selected knowledge bases: ``bases`` has ``kb, model, active``, ``asked`` is ``query_id, query, model, embedding``.

    Bases that are missing or not active are skipped (``selected`` None: all that are active), as
    are queries without a vector of a model (one that failed to embed): the keyword path still
    finds for them.  Vectors of one width are searched in one pass, each model's by its own
    queries; the models' candidates are cut each, ranked together and cut again.
    """
    top_k = clamp_top_k(top_k)
    cut = candidate_k(top_k)
    used = bases.where("active").select("kb", "model")
    used = used if selected is None else used.where(F.col("kb").isin(selected))
    shown = chunks.where("is_published").join(used, "kb")
    found = None
    for dim in sorted(set(dims.values())):  # one pass a width
        models = [m for m, d in dims.items() if d == dim]
        own = asked.where((F.col("query") != "") & F.col("model").isin(models) & F.col("embedding").isNotNull()).withColumnRenamed("model", "group")
        part = vector.top_k(own, shown.where(F.col("model").isin(models)), cut, dim, "model").drop("group")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cut)
    words = asked.where("query <> ''").select("query_id", "query").distinct()
    return _combine(words, shown, found, top_k, neighbors)


def _combine(asked: DataFrame, shown: DataFrame, v: DataFrame, top_k: int, neighbors: bool) -> DataFrame:
    """Keyword search beside the vector candidates, and all that follows."""
    cut = candidate_k(top_k)
    k = trigram.search(asked.select("query_id", "query"), shown.select("id", "content"), cut)
    ranked = v.select("query_id", F.lit("vector").alias("path"), "id", F.col("rank").alias("pos"), "score").unionByName(k.select("query_id", F.lit("keyword").alias("path"), "id", F.col("rank").alias("pos"), "score"))
    fused = fusion.fuse(ranked).where(fusion.admitted(F.col("vector_score"), F.col("keyword_score")))
    # at most two candidate lists a query: written, so that contents are joined to a side of known size, not shuffled
    fused = stored(fused, f"{shared_dir(asked.sparkSession, 'retrieve')}/fused")
    facts = shown.select("id", "document_id", "document_version", "chunk_index", "content")
    anchors = fusion.admit_dedup_top_k(fused.join(facts, "id"), top_k)
    if not neighbors:
        return anchors
    # at most top_k rows a query: written, so that the searches below are not made once for each use
    anchors = stored(anchors, f"{shared_dir(asked.sparkSession, 'retrieve')}/anchors")
    return fusion.with_neighbors(anchors, shown)
