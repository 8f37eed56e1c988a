"""Problem 4: records that differ only in formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import alnum, has_text, is_blank
from glosswork.session import cut


def canonical_url(url: Column) -> Column:
    """Letters and digits of ``url`` in lower case, its query parameters in order."""
    base = F.regexp_extract(url, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(url, r"(?s)^[^?]*\?(.*)$", 1)
    parameters = F.array_sort(F.transform(F.split(query, "&"), alnum))
    return F.concat(alnum(base), F.array_join(parameters, ""))


def _eligible(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "article_text").where(~is_blank(F.col("url")) & has_text(F.col("article_text")))


def _raw_key(url: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("\u0000", url, text), 256))


def _survivors(pages: DataFrame) -> DataFrame:
    """One row per byte-identical (url, article_text): first page_id, copies, raw and canonical key."""
    raw = _eligible(pages).groupBy("url", "article_text").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    canonical = F.concat_ws("\u0000", canonical_url(F.col("url")), alnum(F.col("article_text")))
    return raw.select("first_id", "copies", _raw_key(F.col("url"), F.col("article_text")).alias("raw_key"), F.unhex(F.sha2(canonical, 256)).alias("canonical_key"))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, copies, spellings): one row per record, under its smallest page_id.

    Byte-identical rows are collapsed first with their counts; only the distinct
    survivors are brought to canonical form, whose whole text (by a digest of 256
    bits) is grouped again, summing the counts. Both groupings aggregate before the
    shuffle, so a record that fills a third of the table is reduced where it is read.

    copies counts pages, spellings distinct raw rows. Pages with null or blank url
    or without text (null, blank or the crawler's default) belong to no record.
    Texts without letters and digits are equal to one another. An empty table gives no rows.
    """
    return _survivors(pages).groupBy("canonical_key").agg(F.min("first_id").alias("page_id"), F.sum("copies").alias("copies"), F.count("*").alias("spellings")).drop("canonical_key")


def copies(pages: DataFrame) -> DataFrame:
    """(page_id_a, page_id_b): the smallest page_id of each record and every other member of it.

    The survivors (ids and keys, no texts) go to the checkpoint folder, as they are read twice. Members find their record by the raw key; the pages are the large side of that
    join, which adaptive execution splits where one key is hot.
    """
    kept = cut(_survivors(pages))
    groups = kept.groupBy("canonical_key").agg(F.min("first_id").alias("page_id_a"), F.sum("copies").alias("n")).where("n > 1").drop("n")
    by_raw = kept.select("raw_key", "canonical_key").join(groups, "canonical_key").select("raw_key", "page_id_a")
    members = _eligible(pages).select(F.col("page_id").alias("page_id_b"), _raw_key(F.col("url"), F.col("article_text")).alias("raw_key"))
    return members.join(by_raw, "raw_key").where("page_id_b <> page_id_a").select("page_id_a", "page_id_b")
