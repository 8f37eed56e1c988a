"""Tokens and terms of a text as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.resources import CZECH_SUFFIXES, STOPWORDS, accent_classes, accent_map, language_code

# White space, word characters and digits by Unicode, as classes for the regex engine.
SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = r"\p{L}\p{N}_"
# The classes of tokens, tried in this order.
URL = rf'https?://[^{SPACES}<>"]+|www\.[^{SPACES}<>"]+'
_IN, _OUT = rf"(?<![{WORDS}])", rf"(?![{WORDS}])"
DATE = rf"{_IN}\p{{Nd}}{{1,2}}[./-]\p{{Nd}}{{1,2}}[./-]\p{{Nd}}{{2,4}}{_OUT}|{_IN}\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}{_OUT}"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
WORD = rf"[{WORDS}]+"
TAG = r"<[^>]+>"
PUNCT = rf"[^{WORDS}{SPACES}]+"
TOKEN = f"{URL}|{DATE}|{NUMBER}|{WORD}|{TAG}|{PUNCT}"

Step = Callable[[Column], Column]


def raw_tokens(text: Column) -> Column:
    """All tokens of ``text`` in order, as written; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def content_tokens(text: Column) -> Column:
    """Words, numbers and dates of ``text`` in order, as written; empty for null.

    All classes are matched in their order, but only these are captured, so no token is matched twice.
    """
    found = F.regexp_extract_all(text, F.lit(f"{URL}|({DATE}|{NUMBER}|{WORD})|{TAG}|{PUNCT}"), F.lit(1))
    return F.coalesce(F.filter(found, lambda t: t != ""), F.array().cast("array<string>"))


def token_type(token: Column) -> Column:
    """URL, DATE, NUMBER, WORD, TAG or PUNCT, told from the token alone."""
    return (
        F.when(token.rlike(r"^(?:https?://.|www\..)"), "URL")
        .when(token.rlike(r"^(?:\p{Nd}{1,2}[./-]\p{Nd}{1,2}[./-]\p{Nd}{2,4}|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2})$"), "DATE")
        .when(token.rlike(rf"^{NUMBER}$"), "NUMBER")
        .when(token.rlike(rf"^[{WORDS}]"), "WORD")
        .when(token.rlike(r"^<[^>]+>$"), "TAG")
        .otherwise("PUNCT")
    )


def is_content(token: Column) -> Column:
    """True for words, numbers and dates; false for addresses, tags and punctuation."""
    return token.rlike(rf"^[{WORDS}]") & ~token.rlike(r"^(?:https?://.|www\..)")


def strip_accents(term: Column) -> Column:
    """``term`` in compatibility decomposition without combining marks.

    Common letters go by a map; a term with any other character goes through the Unicode library of the JVM.
    """
    other, marks = accent_classes()
    whole = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), term, F.lit(True))
    return F.when(term.rlike(other), F.regexp_replace(whole, marks, "")).otherwise(F.translate(term, *accent_map()))


def stem_czech(term: Column) -> Column:
    """``term`` without the longest of the Czech suffixes, if five characters or more and three remain.

    Only words are cut: a number or date ends in no suffix.
    """
    cut = None
    for suffix in CZECH_SUFFIXES:
        fits = term.endswith(suffix) & (F.length(term) >= max(5, len(suffix) + 3))
        rest = F.substring(term, F.lit(1), F.length(term) - len(suffix))
        cut = F.when(fits, rest) if cut is None else cut.when(fits, rest)
    return cut.otherwise(term)


def terms(text: Column, language: str = "cs", stem: bool = False) -> Column:
    """Terms of ``text``: lower case, content tokens only, without accents, stopwords and single characters.

    With ``stem``, Czech terms lose their suffix last. Null and blank text give an empty array.
    """
    code = language_code(language)
    stop = STOPWORDS[code]
    folded = lambda t: F.when(t.rlike(r"[^\x00-\x7f]"), strip_accents(F.lower(t))).otherwise(F.lower(t))
    bare = F.transform(content_tokens(text), folded)
    out = F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.isin(stop))
    return F.transform(out, stem_czech) if stem and code == "cs" else out


def plain_terms(text: Column) -> Column:
    """Lower-cased runs of word characters: the tokenizer of small collections."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def space_terms(text: Column) -> Column:
    """Pieces of ``text`` between white space."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda t: t != "")


def _places(gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, n, token, position) of batches of (key, pieces), pieces being (token, keep); each piece is followed by ``gap`` more characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(1)
                counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
                token, keep = flat.field(0), flat.field(1).to_numpy(zero_copy_only=False).astype(bool)
                sizes = pc.utf8_length(token).to_numpy(zero_copy_only=False).astype(np.int64) + gap
                row = np.repeat(np.arange(len(counts)), counts)
                first = (np.cumsum(counts) - counts)[row]
                start, number = np.cumsum(sizes) - sizes, np.cumsum(keep)
                position = start - start[first] if len(row) else start
                n = number - (number - keep)[first] if len(row) else number
                on = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[on])), pa.array(n[on].astype(np.int32)), token.take(pa.array(on)), pa.array(position[on])], names=["k", "n", "token", "position"])

    return run


def _placed(docs: DataFrame, key: str, pieces: Column, keep: Callable[[Column], Column], gap: int) -> DataFrame:
    """(k, n, token, position) of the pieces of each text that are kept.

    The lengths are added up over the row's own array, a batch of rows at a time, so nothing is shuffled and rows with equal keys are not mixed.
    """
    told = F.transform(F.coalesce(pieces, F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), keep(t).alias("keep")))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), told.alias("pieces")).mapInArrow(_places(gap), f"k {kind}, n int, token string, position bigint")


def typed_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, n, token, type, position, length): every token with its place in the text.

    White space is matched along with the tokens, so that lengths add up to positions (in
    characters, from 0). Null and empty texts give no rows; each row's tokens are counted by themselves, also where keys are null or repeat.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{TOKEN}|[{SPACES}]+"), F.lit(0))
    rows = _placed(docs, key, pieces, lambda t: ~t.rlike(f"^[{SPACES}]"), 0)
    return rows.select(F.col("k").alias(key), "n", "token", token_type(F.col("token")).alias("type"), "position", F.length("token").alias("length"))


def split_tokens(docs: DataFrame, key: str, text: str, separator: str = " ") -> DataFrame:
    """(``key``, n, token, position): pieces between single separators, empty ones kept. Null texts give no rows."""
    rows = _placed(docs, key, F.split(F.col(text), r"\Q" + separator + r"\E"), lambda t: F.lit(True), len(separator))
    return rows.select(F.col("k").alias(key), "n", "token", "position")


def lemmatise(rows: DataFrame, lemmas: DataFrame, term: str = "term") -> DataFrame:
    """``rows`` with a column lemma: the dictionary's lemma of the form, the form itself if it has none.

    ``lemmas`` holds (form, lemma) of one language; of several lemmas of a form the least counts.
    """
    best = lemmas.where("form is not null and lemma is not null").groupBy(F.col("form").alias("_form")).agg(F.min("lemma").alias("_lemma"))
    joined = rows.join(best, rows[term] == best["_form"], "left")
    return joined.withColumn("lemma", F.coalesce("_lemma", F.col(term))).drop("_form", "_lemma")
