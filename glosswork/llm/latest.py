"""The rows of preprocessed_docs that count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.bitmap import marked


def latest(docs: DataFrame, value: str) -> DataFrame:
    """(pipeline, doc_id, ``value``) of the row with the greatest row_id per pipeline and doc_id.

    A key that is written very often is reduced on the map side before the
    shuffle. Null pipeline or doc_id is a key of its own; a row without row_id
    never wins over one with. The result is partitioned by (pipeline, doc_id).
    """
    row = F.struct(F.col("row_id"), F.col(value).alias("value"))
    return docs.groupBy("pipeline", "doc_id").agg(F.max_by(row["value"], F.coalesce(F.col("row_id"), F.lit(-(2**62)))).alias(value))


def latest_in_place(docs: DataFrame, value: str) -> DataFrame:
    """The rows of ``latest``, but those whose key is written once stay where they are; only the others are shuffled.

    Keys are counted first, without their values. A filter of fixed size tells where a key may be written more than once.
    """
    key = F.xxhash64("pipeline", "doc_id")
    again = docs.groupBy("pipeline", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select(key.alias("key"))
    told = marked(docs.select("pipeline", "doc_id", "row_id", value), key, again)
    once = told.where("not _marked").select("pipeline", "doc_id", value)
    return once.unionByName(latest(told.where("_marked"), value))
