"""Hybrid search: vector leg and keyword leg, fused by rank, formatted last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EngineConfig
from ..functions.keywords import route_text
from ..operators import fusion, lexical, nearest


def legs(
    vectors: DataFrame, index: lexical.LexicalIndex, queries: DataFrame, query_vector: list[float], k: int, *, category: str | None, config: EngineConfig, id_col: str = "id", category_col: str = "category"
) -> tuple[DataFrame, DataFrame]:
    """Semantic (query_id, id, rank) and keyword (query_id, id, score, rank) candidates of one query.

    The category filters the semantic leg; with filter_scope "both" the keyword
    leg too, before its candidates are cut.
    """
    near = vectors.filter(F.col(category_col) == category) if category else vectors
    semantic = nearest.nearest(near, query_vector, min(3 * k, config.max_results), id_col=id_col)
    semantic = semantic.crossJoin(F.broadcast(queries.select("query_id"))).select("query_id", "id", "rank")  # one query
    if category and config.filter_scope == "both":
        inside = vectors.filter(F.col(category_col) == category).select(F.col(id_col).alias("id"))
        index = lexical.LexicalIndex(index.postings.join(inside, "id", "left_semi"), index.terms, index.corpus)
    return semantic, lexical.search(index, queries, 3 * k)


def format_results(fused: DataFrame, chunks: DataFrame, routed: str | None, id_col: str = "chunk_id") -> DataFrame:
    """Result rows in rank order; texts are fetched now, for the few that are left."""
    or_empty: Column = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = F.broadcast(fused).join(chunks, F.col("id") == F.col(id_col), "left")  # k rows a query
    return rows.orderBy("query_id", "rank").select(
        or_empty("content").alias("content"),
        or_empty("source").alias("source"),
        or_empty("filename").alias("filename"),
        or_empty("category").alias("category"),
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        "score",
        "semantic_rank",
        "bm25_rank",
        "search_method",
        F.split(or_empty("keywords"), ",").alias("keywords"),
        F.lit(routed or "none").alias("routed_by"),
    )


def search(index, query: str, k: int, category: str | None = None, alpha: float = 0.5) -> DataFrame:
    """Search a stored :class:`brindle.plans.index.Index`.  An explicit category comes before the routed one."""
    from ..sources.embedding import embed_query

    routed = route_text(query, index.config.keyword_routes)
    only = category or routed
    chunks = index.chunks()
    both = only and index.config.filter_scope == "both"
    inside = chunks.filter(F.col("category") == only).select(F.col("chunk_id").alias("id")) if both else None
    named = lambda df: df.select(F.lit("q").alias("query_id"), "id", "rank")
    semantic = named(index.vector_search(embed_query(index.embedder, query)[0], min(3 * k, index.config.max_results), only))
    keyword = named(index.keyword_search(query, 3 * k, inside))
    return format_results(fusion.fuse(semantic, keyword, alpha, k), chunks, routed)
