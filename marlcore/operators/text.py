"""TF-IDF over text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term: lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term"))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return tokens(docs, id_col, text_col).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, documents: int, max_terms: int | None = None) -> DataFrame:
    """term, df, idf = ln((1 + N) / (1 + df)) + 1 of the max_terms most frequent terms, ties in order of the term."""
    per = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    if max_terms:
        per = per.orderBy(F.desc("n"), "term").limit(max_terms)
    return per.select("term", "df", "n", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """id, term, w: tf * idf with rows of length 1; weights are at most max_terms rows."""
    w = counts.join(F.broadcast(weights.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine_top(queries: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
    """query, id, cosine, rank of the n items nearest to each query: an inverted-index join, so only shared terms meet."""
    q = queries.select(F.col("id").alias("query"), "term", F.col("w").alias("wq"))
    scores = items.join(q, "term").groupBy("query", "id").agg(F.round(F.sum(F.col("w") * F.col("wq")), 9).alias("cosine"))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
