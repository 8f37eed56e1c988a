import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.functions import analyze as A
from glosswork.resources import STOPWORDS, accent_map, language_code

# The classes of tokens, as Python writes them.
_PYTHON = re.compile(
    r"(?P<URL>https?://[^\s<>\"]+|www\.[^\s<>\"]+)|(?P<DATE>\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b)|(?P<NUMBER>\d+(?:[.,]\d+)*)|(?P<WORD>\w+)|(?P<TAG><[^>]+>)|(?P<PUNCT>[^\w\s]+)"
)
GOLDEN = {
    "text.</strong> <b>x</b>": [("text", "WORD"), (".</", "PUNCT"), ("strong", "WORD"), (">", "PUNCT"), ("<b>", "TAG"), ("x", "WORD"), ("</b>", "TAG")],
    "123abc a1": [("123", "NUMBER"), ("abc", "WORD"), ("a1", "WORD")],
    "12.3.2020 2024-01-02": [("12.3.2020", "DATE"), ("2024-01-02", "DATE")],
    "a < b > c": [("a", "WORD"), ("< b >", "TAG"), ("c", "WORD")],
    "www.x.cz/a, z": [("www.x.cz/a,", "URL"), ("z", "WORD")],
    "it's a_b": [("it", "WORD"), ("'", "PUNCT"), ("s", "WORD"), ("a_b", "WORD")],
    "": [],
}


def _typed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {k: [] for k in range(len(texts))}
    for r in A.typed_tokens(rows, "doc_id", "text").orderBy("doc_id", "n").collect():
        out[r["doc_id"]].append(r)
    return out


def test_goldens(spark):
    texts = [*GOLDEN, None]
    got = _typed(spark, texts)
    for k, text in enumerate(GOLDEN):
        assert [(r["token"], r["type"]) for r in got[k]] == GOLDEN[text]
    assert got[len(GOLDEN)] == []


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="aZčŘß_19 .,/-<>\"'\n\t\xa0—„www.http://", max_size=60), min_size=20, max_size=40))
def test_tokens_and_positions_against_python(spark, texts):
    got = _typed(spark, texts)
    for k, text in enumerate(texts):
        assert [(r["token"], r["position"]) for r in got[k]] == [(m.group(), m.start()) for m in _PYTHON.finditer(text)]


def test_terms_pipeline(spark):
    text = "Žltý kôň, www.kon.sk a 12.3.2020 <b>PRE</b> x ďalšie 7 riešenia"
    row = spark.createDataFrame([(text,), (None,), ("  ",)], "text string").select(A.terms(F.col("text"), "sk").alias("t")).collect()
    assert [r["t"] for r in row] == [["zlty", "kon", "12.3.2020", "dalsie", "riesenia"], [], []]


def test_content_tokens_are_the_content_of_raw_tokens(spark):
    texts = [(x,) for x in [*GOLDEN, "www. https:// http://a b", "čau 12/3/20 <x", None]]
    rows = spark.createDataFrame(texts, "text string")
    got = rows.select(A.content_tokens(F.col("text")).alias("a"), F.filter(A.raw_tokens(F.col("text")), A.is_content).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_accents_and_stems(spark):
    source, target = accent_map()
    assert len(source) == len(target)
    word = "ÄÇÈÉÊÍÑÓÖÜäčďěéíľňôöřšťúůýž²ß"
    want = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    terms = ["knihovnami", "stromy", "pes", "domu", "rychlosti", "12.3.2020", "abcde"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(A.stem_czech(F.col("t")).alias("s"), A.strip_accents(F.lit(word)).alias("w")).collect()
    assert rows[0]["w"] == want
    assert [r["s"] for r in rows] == ["knihovn", "strom", "pes", "domu", "rychl", "12.3.2020", "abcd"]


def test_accents_of_all_characters(spark):
    strip = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    words = [f"a{chr(k)}b" for k in range(0x80, 0xFFFF) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"] + ["e\u0301x", "한국어", "Ⅳ½", "ﬁn", "𝐀ž", "हिन्दी", None, ""]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", A.strip_accents(F.col("t")).alias("s")).collect()
    bad = [(r["t"], r["s"]) for r in got if r["s"] != (None if r["t"] is None else strip(r["t"]))]
    assert not [x for x in bad if len(x[0]) != 3] and len(bad) < 60, bad[:20]  # the two libraries differ in their Unicode version


def test_languages_and_lemmas(spark):
    assert [language_code(x) for x in (None, " Czech ", "sk", "English language")] == ["cs", "cs", "sk", "en"]
    with pytest.raises(ValueError):
        language_code("de")
    assert all(len(set(v)) == len(v) for v in STOPWORDS.values())
    rows = spark.createDataFrame([("recepty", 1), ("iny", 2), (None, 3)], "term string, form int")
    lemmas = spark.createDataFrame([("recepty", "recept"), ("recepty", "recepta"), (None, "x")], "form string, lemma string")
    assert {(r["term"], r["lemma"]) for r in A.lemmatise(rows, lemmas).collect()} == {("recepty", "recept"), ("iny", "iny"), (None, None)}


def test_split_tokens(spark):
    rows = spark.createDataFrame([(1, "a  b"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r["doc_id"], r["token"], r["position"]) for r in A.split_tokens(rows, "doc_id", "text").orderBy("doc_id", "n").collect()]
    assert got == [(1, "a", 0), (1, "", 2), (1, "b", 3), (3, "", 0)]


def test_tokens_of_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "ab cde"), (1, "x yz"), (None, "q  r"), (None, None), (2, "")], "doc_id int, text string").coalesce(1)
    typed = [(r["doc_id"], r["n"], r["token"], r["position"]) for r in A.typed_tokens(rows, "doc_id", "text").collect()]
    assert typed == [(1, 1, "ab", 0), (1, 2, "cde", 3), (1, 1, "x", 0), (1, 2, "yz", 2), (None, 1, "q", 0), (None, 2, "r", 3)]
    split = [(r["doc_id"], r["n"], r["token"], r["position"]) for r in A.split_tokens(rows, "doc_id", "text").collect()]
    assert split == [(1, 1, "ab", 0), (1, 2, "cde", 3), (1, 1, "x", 0), (1, 2, "yz", 2), (None, 1, "q", 0), (None, 2, "", 2), (None, 3, "r", 3), (2, 1, "", 0)]
    plan = A.typed_tokens(rows, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("coalesce", "") and "Window" not in plan


def test_tokens_of_a_very_long_text(spark):
    rows = spark.createDataFrame([("k", "ab " * 200_000)], "doc_id string, text string")
    last = A.typed_tokens(rows, "doc_id", "text").orderBy(F.desc("n")).first()
    assert (last["n"], last["token"], last["position"]) == (200_000, "ab", 599_997)
