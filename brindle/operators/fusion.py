"""Reciprocal-rank fusion of a vector leg and a keyword leg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import MISSING_RANK, RRF_K


def rrf_score(alpha: float, semantic_rank: Column, keyword_rank: Column) -> Column:
    """alpha and its rest weigh 1 / (60 + rank); a leg without the text counts as rank 1000."""
    part = lambda w, r: F.lit(w) * (F.lit(1.0) / (F.lit(RRF_K) + F.coalesce(r, F.lit(MISSING_RANK))))
    return part(float(alpha), semantic_rank) + part(1.0 - float(alpha), keyword_rank)


def search_method(semantic_rank: Column, keyword_rank: Column) -> Column:
    return (
        F.when(semantic_rank.isNotNull() & keyword_rank.isNotNull(), "hybrid").when(semantic_rank.isNotNull(), "semantic").otherwise("keyword")
    )


def fuse(semantic: DataFrame, keyword: DataFrame, alpha: float, k: int) -> DataFrame:
    """The k best of both legs for each query.

    Legs: (query_id, id, rank).  Returns query_id, id, score, semantic_rank,
    bm25_rank, search_method, rank; ties by id.
    """
    both = semantic.select("query_id", "id", F.col("rank").alias("semantic_rank")).join(
        keyword.select("query_id", "id", F.col("rank").alias("bm25_rank")), ["query_id", "id"], "full_outer"
    )
    s, b = F.col("semantic_rank"), F.col("bm25_rank")
    scored = both.select("query_id", "id", rrf_score(alpha, s, b).alias("raw"), s, b, search_method(s, b).alias("search_method"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 12)), "id")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("query_id", "id", F.round("raw", 6).alias("score"), "semantic_rank", "bm25_rank", "search_method", "rank")
