"""BM25 over an inverted index.

postings(id, term, tf, dl) is the index; term and corpus statistics follow from
it.  A search here scans the postings and scores those of its terms only;
:mod:`brindle.operators.postings` stores them so that it need not.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import BM25_B, BM25_EPSILON, BM25_K1
from ..functions.text import TOKEN, tokens

#: Scores are compared at this many decimals, so that sums in another order rank alike.
DECIMALS = 9


@dataclass
class LexicalIndex:
    """postings(id, term, tf, dl), terms(term, df, idf), corpus(n_docs, total_len, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def postings(df: DataFrame, id_col: str, text_col: str, terms: list[str] | None = None) -> DataFrame:
    """id, term, tf and dl (tokens of the text).  Texts without tokens have no rows.

    terms: only these, sorted out before anything is counted or shuffled.
    """
    split = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    wanted = F.col("t") if terms is None else F.filter("t", lambda x: x.isin(terms))
    words = split.select("id", F.size("t").cast("long").alias("dl"), F.explode(wanted).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(df: DataFrame, text_col: str) -> DataFrame:
    """n_docs, total_len and avgdl, texts without tokens included."""
    return df.select(F.coalesce(F.size(tokens(F.coalesce(F.col(text_col), F.lit("")))), F.lit(0)).cast("long").alias("dl")).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"), F.avg("dl").alias("avgdl")
    )


def document_frequency(index: DataFrame) -> DataFrame:
    """term, df from postings."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def text_frequency(df: DataFrame, text_col: str) -> DataFrame:
    """term, df from texts: one shuffle, of partial counts."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _raw_idf(n_docs: int) -> Column:
    return F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def mean_idf(frequency: DataFrame, n_docs: int) -> float | None:
    """The mean over the whole vocabulary, negative ones included; null without terms."""
    return frequency.agg(F.avg(_raw_idf(n_docs))).first()[0]


def term_stats(frequency: DataFrame, n_docs: int, mean: float) -> DataFrame:
    """term, df, idf.  Terms of more than half the texts get a share of the mean idf instead of a negative one."""
    raw = _raw_idf(n_docs)
    return frequency.select("term", "df", F.when(raw < 0, F.lit(BM25_EPSILON) * F.lit(mean).cast("double")).otherwise(raw).alias("idf"))


def query_terms(query: str) -> dict[str, int]:
    """The terms of a query, and how often each stands there."""
    return dict(Counter(re.findall(TOKEN, query.lower())))


def _counted(df: DataFrame, text_col: str) -> DataFrame:
    """term, df, dl: a row for each term, with null dl, and one of a null term with the number of texts and of all their tokens.

    Both come from one pass.  What is worked out of it below reads all three
    columns, so that Spark sees one exchange and makes it once.
    """
    split = df.select(tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).select("t", F.size("t").cast("long").alias("n"))
    term = lambda t: F.struct(t.alias("term"), F.lit(None).cast("long").alias("dl"))
    text = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("n").alias("dl")))
    each = split.select(F.explode(F.concat(F.transform(F.array_distinct("t"), term), text)).alias("e"))
    return each.groupBy("e.term").agg(F.count("*").alias("df"), F.sum("e.dl").alias("dl"))


def build(df: DataFrame, id_col: str, text_col: str, queries: dict[object, str] | None = None) -> LexicalIndex:
    """The index of texts, not stored; with ``queries``, postings and statistics of their terms only.

    A search reads the texts twice: for the statistics of the whole vocabulary,
    and for the postings.
    """
    terms = None if queries is None else sorted({t for q in queries.values() for t in query_terms(q)})
    counted = _counted(df, text_col)
    is_text, none = F.col("dl").isNotNull(), F.lit(0).cast("long")
    corpus = counted.agg(F.coalesce(F.max(F.when(is_text, F.col("df"))), none).alias("n_docs"), F.coalesce(F.max("dl"), none).alias("total_len"))
    corpus = corpus.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")))
    size = F.broadcast(corpus.select("n_docs"))  # one row
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = counted.filter(~is_text).crossJoin(size).agg(F.avg(raw).alias("mean"), F.max("n_docs").alias("n_docs"))
    index = postings(df, id_col, text_col, terms)
    own = counted.filter(~is_text).select("term", "df") if terms is None else document_frequency(index)
    known = own.crossJoin(F.broadcast(mean)).select("term", "df", F.when(raw < 0, F.lit(BM25_EPSILON) * F.col("mean")).otherwise(raw).alias("idf"))  # one row
    return LexicalIndex(index, known, corpus)


def query_table(spark: SparkSession, queries: dict[object, str]) -> DataFrame:
    """query_id, query."""
    return spark.createDataFrame([(k, v) for k, v in queries.items()], "query_id string, query string")


def scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, id, score of all texts that hold a term of the query; repeated terms count as often as they stand."""
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    hit = index.postings.join(asked, "term").join(index.terms.select("term", "idf"), "term").crossJoin(F.broadcast(index.corpus.select("avgdl")))
    length = F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("dl") / F.col("avgdl")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * F.lit(BM25_K1 + 1) / (F.col("tf") + F.lit(BM25_K1) * length)
    return hit.groupBy("query_id", "id").agg(F.round(F.sum(part), DECIMALS).alias("score"))


def search(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """The k best texts of each query with positive scores: query_id, id, score, rank (from 1; ties by id)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scores(index, queries).filter(F.col("score") > 0).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)
