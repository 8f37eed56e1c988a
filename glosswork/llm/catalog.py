"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import distinctive, formatting, frequency, mainbody, neardup, packing, reading, residue, sitelines, tokens
from glosswork.session import table, text_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_terms(table(spark, d, "preprocessed_docs")).where("mark is not null").select("pipeline", "term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_terms(table(spark, d, "preprocessed_docs"))


def p1_vocab(spark: SparkSession, d: str) -> DataFrame:
    return frequency.refreshed_vocab(table(spark, d, "preprocessed_docs"), table(spark, d, "vocab"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(text_table(spark, d, "crawled_pages", "page_id"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(text_table(spark, d, "crawled_pages", "page_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(text_table(spark, d, "crawled_pages", "page_id"))


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The same pages, with what tells them: themselves, or only links to others."""
    return residue.evidence(text_table(spark, d, "crawled_pages", "page_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(table(spark, d, "crawled_pages"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return formatting.records(table(spark, d, "crawled_pages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.top_terms(distinctive.term_scores(table(spark, d, "preprocessed_docs"))).select("doc_id", "term")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.term_scores(table(spark, d, "preprocessed_docs")).select("doc_id", "term", "tf", "df", "cf", (F.round("llr", 4) + F.lit(0.0)).alias("llr"), F.round("weight", 6).alias("weight"))


def p5_distinctive(spark: SparkSession, d: str) -> DataFrame:
    """The terms of each record by likelihood ratio to four digits, as the operator ranks them by itself."""
    scores = distinctive.term_scores(table(spark, d, "preprocessed_docs")).withColumn("llr", F.round("llr", 4))
    return distinctive.top_terms(scores, by="llr").select("doc_id", "term", "place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pages = text_table(spark, d, "crawled_pages", "page_id")
    found = mainbody.lines_around(pages, mainbody.fit(pages))
    return found.join(residue.residue_pages(pages), "page_id", "left_anti").select("page_id", "line_no")


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    pages = text_table(spark, d, "crawled_pages", "page_id")
    return mainbody.bodies(pages, mainbody.fit(pages))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, d, "crawled_pages"))


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The maximal repeated blocks."""
    return sitelines.repeated_blocks(table(spark, d, "crawled_pages"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    return sitelines.without_repeated(pages, sitelines.repeated_lines(pages))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(text_table(spark, d, "documents", "doc_id"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tokens.lengths(text_table(spark, d, "documents", "doc_id"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document decoded from its ids again."""
    return tokens.decode(tokens.encode(text_table(spark, d, "documents", "doc_id")))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.lengths(text_table(spark, d, "documents", "doc_id")), table(spark, d, "container_sizes"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_packing(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = text_table(spark, d, "documents", "doc_id")
    return reading.reading_levels(docs, reading.fit(docs, table(spark, d, "reading_labels"))).select("doc_id", "level")


def p10_words(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty of every word in enough labelled documents."""
    sample = reading.labelled(text_table(spark, d, "documents", "doc_id"), table(spark, d, "reading_labels"))
    return reading.difficulties(sample).select("word", "docs", F.round("difficulty", 6).alias("difficulty"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from glosswork.llm import sql

    return dict(sql.SQL)
