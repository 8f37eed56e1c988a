"""Ranked retrieval: BM25 and TF-IDF cosine, for one query or many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.text import is_blank
from glosswork.operators.index import Index, postings_of, weight_tf

K1, B = 1.5, 0.75
#: Rows of query terms up to which they are broadcast to the postings; more are joined by term.
BROADCAST_TERMS = 200_000


def query_terms(queries: DataFrame, language: str = "cs", stem: bool = False, key: str = "qid", text: str = "text", lemmas: DataFrame | None = None) -> DataFrame:
    """(qid, term, q_tf) of each query with text; repeated rows of a qid add up. Terms as in ``index.postings_of``."""
    kept = queries.select(F.col(key).cast("string").alias("qid"), F.col(text).alias("text")).where(~is_blank(F.col("text")))
    asked = kept.select(F.col("qid").alias("doc_id"), "text")
    return postings_of(asked, language, stem, lemmas).select(F.col("doc_id").alias("qid"), "term", F.col("tf").cast("bigint").alias("q_tf"))


def small(rows: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """``rows`` with a broadcast hint if there are at most ``most`` of them, else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def bm25_idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log(1 + (n - df + 0.5) / (df + 0.5)), F.lit(0.0))


def bm25_scores(index: Index, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score): BM25 of every document that shares a term with the query.

    ``wanted`` holds (qid, term, q_tf). The query terms meet their df first and are then sent to
    the postings, which hold the length of their document, so that those move only if there are very many query terms; what is shuffled is one row per
    (query, document, task). A document without length counts as average, length 0 as 1.
    """
    known = wanted.join(index.terms.select("term", "df"), "term")
    hit = index.postings.join(small(known), "term").crossJoin(F.broadcast(index.stats))
    average = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    length = F.coalesce(F.when(F.col("dl") == 0, 1.0).otherwise(F.col("dl")), average)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / average))
    return hit.groupBy("qid", "doc_id").agg(F.sum(F.col("q_tf") * bm25_idf(F.col("n"), F.col("df")) * part).alias("score"))


def cosine_scores(index: Index, wanted: DataFrame) -> DataFrame:
    """(qid, doc_id, score): cosine of the weighted vectors; only positive scores.

    Terms that the index does not know are no part of the query's vector. A query whose norm is 0 finds nothing.
    """
    known = wanted.join(index.terms.select("term", "idf"), "term").select("qid", "term", "idf", (weight_tf(F.col("q_tf")) * F.col("idf")).alias("w_q"))
    norms = known.groupBy("qid").agg(F.sqrt(F.sum(F.col("w_q") * F.col("w_q"))).alias("q_norm"))
    hit = index.postings.join(small(known), "term")
    dot = hit.groupBy("qid", "doc_id").agg(F.sum(F.col("w_q") * weight_tf(F.col("tf")) * F.col("idf")).alias("dot"))
    scored = dot.join(norms, "qid").join(index.docs.select("doc_id", "norm"), "doc_id")
    score = F.col("dot") / F.nullif(F.col("q_norm") * F.col("norm"), F.lit(0.0))
    return scored.select("qid", "doc_id", score.alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(qid, doc_id, score, rank): the ``k`` best documents of each query; equal scores by doc_id as a string.

    Scores are rounded before they are ranked, so the order does not hang on the order of a sum.
    """
    rounded = scores.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidates(index: Index, wanted: DataFrame) -> DataFrame:
    """(qid, doc_id): documents that share a term with the query."""
    return index.postings.join(small(wanted.select("qid", "term")), "term").select("qid", "doc_id").distinct()


def term_breakdown(index: Index, wanted: DataFrame) -> DataFrame:
    """(qid, term, tf, wtf, tfidf, normalised) of the query's own vector; six digits."""
    known = wanted.join(index.terms.select("term", "idf"), "term")
    weighted = known.select("qid", "term", F.col("q_tf").alias("tf"), weight_tf(F.col("q_tf")).alias("wtf"), (weight_tf(F.col("q_tf")) * F.col("idf")).alias("tfidf"))
    norm = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy("qid")))
    return weighted.select("qid", "term", "tf", F.round("wtf", 6).alias("wtf"), F.round("tfidf", 6).alias("tfidf"), F.round(F.coalesce(F.col("tfidf") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)), 6).alias("normalised"))


def trec_lines(ranked: DataFrame, run: str) -> DataFrame:
    """(line): ranked rows in the six columns of a run file."""
    return ranked.select(F.format_string("%s Q0 %s %d %.6f %s", "qid", "doc_id", "rank", "score", F.lit(run)).alias("line"))
