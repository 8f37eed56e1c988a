"""Problem 5: how characteristic a term is of a record, by likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.text import SPACE, is_blank
from glosswork.llm.latest import latest
from glosswork.session import written

#: Terms whose statistics are broadcast: the most frequent ones, at most so many rows.
HOT_TERMS = 20_000


def _term(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))


def likelihood_ratio(tf: Column, length: Column, cf: Column, total: Column) -> Column:
    """G squared of the two-by-two table (term or not, this record or the rest).

    Zero where the counts agree with independence; negative where the term is
    rarer in the record than elsewhere.
    """
    a, b = tf.cast("double"), (cf - tf).cast("double")
    c, d = (length - tf).cast("double"), (total - length - cf + tf).cast("double")
    n = a + b + c + d
    g = 2 * (_term(a, (a + b) * (a + c) / n) + _term(b, (a + b) * (b + d) / n) + _term(c, (c + d) * (a + c) / n) + _term(d, (c + d) * (b + d) / n))
    return F.when(a * (b + d) < b * (a + c), -F.greatest(g, F.lit(0.0))).otherwise(F.greatest(g, F.lit(0.0)))


def _pairs(docs: DataFrame, pipeline: str) -> DataFrame:
    """(doc_id, term, tf) of the counting records of ``pipeline``; no shuffle beyond that of ``latest``."""
    kept = latest(docs.where(F.col("pipeline") == pipeline), "normalized_text").where(~is_blank(F.col("normalized_text")))
    terms = kept.select("pipeline", "doc_id", F.explode(F.split("normalized_text", SPACE + "+")).alias("term")).where("term <> ''")
    return terms.groupBy("pipeline", "doc_id", "term").agg(F.count("*").alias("tf"))


def term_scores(docs: DataFrame, pipeline: str = "baseline", hot_terms: int = HOT_TERMS) -> DataFrame:
    """(doc_id, term, tf, df, cf, length, n, llr, weight) for every term of every counting record.

    One pass counts terms in records and writes them down; a second aggregates them over the
    collection. The statistics of the ``hot_terms`` most frequent terms (a fixed
    number of rows) are broadcast, so the pairs of common terms never move; the
    others are joined by term, where no term can be hot any more.

    llr is the likelihood ratio of the contingency table of the term in the record
    against the remaining collection; weight is (1 + log10 tf) * log10(n / df).
    Records with null or blank text have no terms; terms are compared as stored. An
    empty table gives no rows.
    """
    pairs = _pairs(docs, pipeline)
    length = Window.partitionBy("pipeline", "doc_id")
    pairs = written(pairs.withColumn("length", F.sum("tf").over(length)))
    stats = pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    whole = pairs.groupBy("pipeline", "doc_id").agg(F.sum("tf").alias("tokens")).agg(F.count("*").alias("n"), F.sum("tokens").alias("total"))
    hot = stats.orderBy(F.desc("df"), "term").limit(hot_terms).withColumnRenamed("term", "hot_term")
    tagged = pairs.join(F.broadcast(hot), pairs.term == hot.hot_term, "left")
    near = tagged.where("hot_term is not null").select("doc_id", "term", "tf", "length", "df", "cf")
    far = tagged.where("hot_term is null").select("doc_id", "term", "tf", "length").join(stats, "term").select("doc_id", "term", "tf", "length", "df", "cf")
    both = near.unionByName(far).crossJoin(F.broadcast(whole))
    weight = (1 + F.log10("tf")) * F.log10(F.col("n") / F.col("df"))
    return both.select("doc_id", "term", "tf", "df", "cf", "length", "n", likelihood_ratio(F.col("tf"), F.col("length"), F.col("cf"), F.col("total")).alias("llr"), weight.alias("weight"))


def top_terms(scores: DataFrame, by: str = "weight", k: int = 3, least_df: int = 2) -> DataFrame:
    """The ``k`` terms of each record with the greatest ``by`` among those of df ``least_df`` or more.

    Equal scores come in ascending order of term. A record without such a term has no row.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc(by), F.asc("term"))
    return scores.where(F.col("df") >= least_df).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
