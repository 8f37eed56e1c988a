"""Snippets with the matched terms in brackets, and result tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_TEXT = "[no text available for this document]"
BEFORE, AFTER, HEAD = 80, 120, 220
# White space by Unicode.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def longest_first(terms: list[str]) -> list[str]:
    return sorted(dict.fromkeys(terms), key=len, reverse=True)


def query_terms_of(query: str, analysed: list[str] | None = None) -> list[str]:
    """Terms to mark: those of the pipeline, else the plain words of the query without operators; each once, in order."""
    if analysed:
        return list(dict.fromkeys(analysed))
    return list(dict.fromkeys(w for w in (x.lower() for x in re.findall(r"[A-Za-z0-9_]+", query)) if w not in ("and", "or", "not")))


def highlight(text: Column, terms: list[str]) -> Column:
    """``text`` with every occurrence of a term in double brackets, whatever its case.

    Longer terms first, one after the other, so a shorter one may be marked again within a longer.
    """
    for term in longest_first(terms):
        text = F.regexp_replace(text, r"(?iu)\Q" + term + r"\E", "[[$0]]")
    return text


def snippet(text: Column, terms: list[str]) -> Column:
    """The surroundings of the first occurrence of the longest term that occurs, with marks.

    Without an occurrence the head of the text; a fixed notice where there is no text.
    """
    body = F.btrim(text, F.lit(BLANKS))
    lowered = F.lower(body)
    hit = None
    for term in longest_first(terms):
        place = F.struct(F.nullif(F.instr(lowered, term.lower()), F.lit(0)).alias("at"), F.lit(len(term)).alias("size"))
        hit = F.array(place) if hit is None else F.array_append(hit, place)
    first = F.get(F.filter(hit, lambda x: x["at"].isNotNull()), F.lit(0)) if hit is not None else None
    at, size = (first["at"] - 1, first["size"]) if hit is not None else (None, None)
    length = F.length(body)
    head = F.concat(F.substring(body, 1, HEAD), F.when(length > HEAD, "...").otherwise(""))
    if at is None:
        cut = head
    else:
        left = F.greatest(F.lit(0), at - BEFORE)
        right = F.least(length, at + size + AFTER)
        around = F.concat(F.when(left > 0, "...").otherwise(""), F.substring(body, left + 1, right - left), F.when(right < length, "...").otherwise(""))
        cut = F.when(at.isNull(), head).otherwise(around)
    return F.when(F.coalesce(length, F.lit(0)) == 0, NO_TEXT).otherwise(highlight(cut, terms))


def with_snippets(ranked: DataFrame, texts: DataFrame, terms: list[str]) -> DataFrame:
    """``ranked`` with a snippet column from (doc_id, text); documents without text get the notice."""
    return ranked.join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left").withColumn("snippet", snippet(F.col("_text"), terms)).drop("_text")


def result_table(ranked: DataFrame, metadata: DataFrame) -> DataFrame:
    """(qid, rank, title, doc_id, score): rows for display; titles cut to 30 characters, scores as text with four digits.

    ``metadata`` holds (doc_id, title) once per document; ``Unknown`` where it has none.
    """
    titled = ranked.join(metadata.select("doc_id", F.col("title").alias("_title")), "doc_id", "left")
    return titled.select("qid", "rank", F.substring(F.coalesce("_title", F.lit("Unknown")), 1, 30).alias("title"), "doc_id", F.format_string("%.4f", "score").alias("score"))


def size_text(size: Column) -> Column:
    """A number of bytes in B, KB, MB, GB or TB with one digit; null for null."""
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        one = F.format_string("%d B", size.cast("bigint")) if k == 0 else F.format_string(f"%.1f {unit}", size / 1024**k)
        limit = size < 1024 ** (k + 1)
        out = F.when(limit, one) if out is None else out.when(limit, one) if k < 4 else out.otherwise(one)
    return F.when(size.isNotNull(), out)
