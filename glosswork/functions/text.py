"""Column expressions on urls, blanks and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default that the crawler stores where a page had no article.
NO_ARTICLE = "No Article Text Found"
#: White space by the Unicode property, and the four separators that Python adds.
SPACE = r"(?U)[\s\x1c-\x1f]"


def is_blank(text: Column) -> Column:
    """True for null and for text of white space only."""
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def has_text(article: Column) -> Column:
    """True where a crawled page holds an article: not null, blank or the default."""
    return ~is_blank(article) & (F.trim(article) != NO_ARTICLE)


def site_of(url: Column) -> Column:
    """Lower-cased host of ``url`` without port and leading ``www.``; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#]+)", 1))
    site = F.regexp_replace(host, r"^www\.", "")
    return F.when(site != "", site)


def alnum(text: Column) -> Column:
    """Letters and digits of ``text``, lower-cased; everything else dropped."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
