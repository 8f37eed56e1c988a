"""Fields of HTML pages as column expressions; the article's text by a vectorised parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What the crawler stores where a field is missing, and where it looks for the article.
NO_TITLE, NO_AUTHOR, NO_TOPIC = "No Title Found", "No Author Found", "No Topic Found"
NO_ARTICLE, NO_DATE = "No Article Text Found", "No Publication Date Found"
ARTICLE_ID, TOPIC_CLASS, DATE_CLASS = "clanok", "topic", "entry-date"

# The entities that are decoded without a parser; the ampersand last.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    for written, meant in _ENTITIES:
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def _inner(html: Column, pattern: str) -> Column:
    return F.trim(decode_entities(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]*>", "")))


def _attribute(html: Column, tag: str, where: str, name: str) -> Column:
    """The value of ``name`` in the first ``tag`` whose attributes match ``where``; empty if there is none."""
    opening = F.regexp_extract(html, rf"(?is)<{tag}\b(?=[^>]*{where})[^>]*>", 0)
    return F.trim(decode_entities(F.regexp_extract(opening, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)))


def title(html: Column) -> Column:
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), _inner(html, r"(?is)<title[^>]*>(.*?)</title>")).otherwise(NO_TITLE)


def author(html: Column) -> Column:
    where = r"""\bname\s*=\s*["']author["']"""
    return F.when(html.rlike(rf"(?is)<meta\b(?=[^>]*{where})[^>]*\bcontent\s*="), _attribute(html, "meta", where, "content")).otherwise(NO_AUTHOR)


def topic(html: Column) -> Column:
    tag = rf"""(?is)<a\b(?=[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{TOPIC_CLASS}(?:\s[^"']*)?["'])[^>]*>(.*?)</a>"""
    return F.when(html.rlike(tag), _inner(html, tag)).otherwise(NO_TOPIC)


def publication_date(html: Column) -> Column:
    """``datetime`` of the entry date, else its ``content``; empty if it has neither."""
    where = rf"""\bclass\s*=\s*["'](?:[^"']*\s)?{DATE_CLASS}(?:\s[^"']*)?["']"""
    stated, other = _attribute(html, "time", where, "datetime"), _attribute(html, "time", where, "content")
    return F.when(html.rlike(rf"(?is)<time\b(?=[^>]*{where})"), F.when(stated != "", stated).otherwise(other)).otherwise(NO_DATE)


def links(html: Column) -> Column:
    """All ``href`` of anchors in order, each once."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), decode_entities))


class _Article(HTMLParser):
    """Collects the text nodes within the article, each stripped."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.found, self.parts = 0, False, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.depth:
            self.depth += tag not in self.VOID
        elif not self.found and tag == "article" and dict(attrs).get("id") == ARTICLE_ID:
            self.depth, self.found = 1, True

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag not in self.VOID:
            self.depth = 0 if tag == "article" else max(1, self.depth - 1)

    def handle_data(self, data: str) -> None:
        if self.depth and data.strip():
            self.parts.append(data.strip())


def _article(html: str | None) -> str:
    if not html or not re.search(r"<article\b", html, re.IGNORECASE):
        return NO_ARTICLE
    parser = _Article()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts) if parser.found else NO_ARTICLE


@F.pandas_udf(StringType())
def article_text(html: pd.Series) -> pd.Series:
    """The stripped text nodes of the article joined without a separator; the default where there is no article.

    Nested markup has no regular form, so this one field takes a parser, over batches of columns.
    """
    return html.map(_article)

