"""Incremental ingest: records arrive as files, postings and statistics follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glosswork.operators.index import postings_of


def page_stream(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """A stream over the JSON-lines files that are put into ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def first_seen(stream: DataFrame, key: str = "url", at: str = "scraped_at", late: str = "2 days") -> DataFrame:
    """The first record of each ``key`` within ``late``; records that come later than that are new again.

    State is one key per record of that time, on disk with the checkpoint, not the whole visited set.
    """
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def topic_counts(stream: DataFrame, at: str = "scraped_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(day, topic, pages): pages per window of event time and topic."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.trim(F.lower("topic")).alias("topic")).agg(F.count("*").alias("pages")).select(F.col("w.start").alias("day"), "topic", "pages")


def index_stream(documents: DataFrame, postings_path: str, checkpoint: str, language: str = "cs") -> StreamingQuery:
    """Appends the postings of each batch of (doc_id, text) below ``postings_path``, in a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so no posting is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings_of(batch, language).write.mode("overwrite").parquet(f"{postings_path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_postings(spark: SparkSession, postings_path: str) -> DataFrame:
    """The postings of the last batch of each document."""
    rows = spark.read.parquet(postings_path)
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi").select("term", "doc_id", "tf")
