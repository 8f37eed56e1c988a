"""Retrieval quality against relevance judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ap, p_at_k, ndcg, rr) of every query with a judged relevant document and a result.

    ``run`` holds (qid, doc_id, score), ``qrels`` (qid, doc_id, rel). Results are ordered by score, equal
    ones by doc_id from last to first. Documents without judgment are not relevant; of repeated judgments the highest counts.
    """
    judged = qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel")).where("rel > 0")
    ideal_order = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    ideal = judged.withColumn("i", F.row_number().over(ideal_order)).groupBy("qid").agg(F.count("*").alias("relevant"), F.sum(F.col("rel") / F.log2(F.col("i") + 1)).alias("ideal"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))
    placed = run.withColumn("place", F.row_number().over(order)).join(judged, ["qid", "doc_id"], "left").withColumn("gain", F.coalesce("rel", F.lit(0))).withColumn("hit", (F.col("gain") > 0).cast("int"))
    so_far = Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumn("hits", F.sum("hit").over(so_far))
    sums = counted.groupBy("qid").agg(
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("place")).otherwise(0.0)).alias("precision"),
        F.sum(F.when(F.col("place") <= k, F.col("hit")).otherwise(0)).alias("top"),
        F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("gained"),
        F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"),
    )
    return sums.join(ideal, "qid").select("qid", (F.col("precision") / F.col("relevant")).alias("ap"), (F.col("top") / k).alias("p_at_k"), (F.col("gained") / F.col("ideal")).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def means(per_query: DataFrame) -> DataFrame:
    """(queries, map, p_at_k, ndcg, mrr) over the queries of ``query_metrics``; six digits."""
    return per_query.agg(F.count("*").alias("queries"), *(F.round(F.avg(a), 6).alias(b) for a, b in (("ap", "map"), ("p_at_k", "p_at_k"), ("ndcg", "ndcg"), ("rr", "mrr"))))


def against_goals(timings: DataFrame) -> DataFrame:
    """(stage, seconds, goal, met) of (stage, seconds): the recorded goals for indexing and ranking."""
    goal = F.when(F.col("stage") == "indexing", 300.0).when(F.col("stage") == "ranked", 60.0)
    return timings.select("stage", "seconds", goal.alias("goal"), (F.col("seconds") < goal).alias("met"))
