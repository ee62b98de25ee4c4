"""Catalog reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def list_categories(catalog: DataFrame) -> DataFrame:
    """category, documents; null categories are "unknown"."""
    return catalog.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("documents"))


def list_documents(catalog: DataFrame, category: str | None = None) -> DataFrame:
    """doc_id, source, category, format, chunks and the first five keywords; of one category or, without, of all."""
    rows = catalog.filter(F.col("category") == category) if category else catalog
    return rows.select("doc_id", "source", "category", "format", "chunks", F.slice("keywords", 1, 5).alias("keywords"))


def index_stats(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """total_documents and total_chunks."""
    return catalog.agg(F.count("*").alias("total_documents")).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("total_chunks"))))  # one row each


def new_documents(parsed: DataFrame, catalog: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the catalog doesn't hold yet."""
    return parsed.join(catalog.select(id_col), id_col, "left_anti")
