import math

import pytest
from pyspark.sql import functions as F

from glosswork.functions.analyze import plain_terms
from glosswork.operators import boolean, evaluate, index, rank, snippet

DOCS = [("d1", "cat dog cat"), ("d2", "dog fish"), ("d3", "fish bird bird bird"), ("d10", "dog fish")]
STOP = {"the", "of", "is"}
TRUTH = {
    "cat dog": "d1 d10 d2", "cat AND dog": "d1", "dog and not cat": "d10 d2", "NOT cat": "d10 d2 d3", "NOT cat AND dog": "d10 d2", "cat OR dog AND fish": "d1 d10 d2",
    "(cat OR dog) AND fish": "d10 d2", "NOT NOT cat": "d1", "cat NOT dog": "d1 d3", "(cat)(bird)": "d1 d3", "cat-fish AND dog": "d1 d10 d2", "zebra OR cat": "d1", "NOT zebra": "d1 d10 d2 d3",
    "the AND cat": "", "cat AND the": "", "AND cat": "", "cat NOT AND dog": "", "cat dog AND": "", "cat AND (dog": "", "cat) AND dog": "", "()": "", "the": "", "": "",
}
POSTFIX = {"cat OR dog AND fish": "cat dog fish AND OR", "NOT NOT cat": "cat NOT NOT", "cat-fish AND dog": "cat fish OR dog AND", "cat NOT dog": "cat dog NOT OR"}


@pytest.fixture(scope="module")
def toy(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    postings = docs.select("doc_id", F.explode(plain_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf")).select("term", "doc_id", "tf")
    return index.build(docs, postings=postings)


def _ask(spark, text):
    words = [w for w in text.split()]
    rows = [("q", w, words.count(w)) for w in dict.fromkeys(words)]
    return spark.createDataFrame(rows, "qid string, term string, q_tf bigint")


def _listed(scores):
    return [(r["doc_id"], r["score"]) for r in rank.top_k(scores, 10).orderBy("rank").collect()]


def test_statistics(toy):
    assert {(r["term"], r["df"], round(r["idf"], 6)) for r in toy.terms.collect()} == {("cat", 1, 0.60206), ("bird", 1, 0.60206), ("dog", 3, 0.124939), ("fish", 3, 0.124939)}
    assert {(r["doc_id"], r["dl"], round(r["norm"], 5)) for r in toy.docs.collect()} == {("d1", 3, 0.7932), ("d2", 2, 0.17669), ("d3", 4, 0.89805), ("d10", 2, 0.17669)}
    assert tuple(toy.stats.first()) == (4, 2.75)


@pytest.mark.parametrize(
    ("query", "cosine", "bm25"),
    [
        ("cat fish", [("d1", 0.966917), ("d10", 0.143677), ("d2", 0.143677), ("d3", 0.028268)], [("d1", 1.671129), ("d10", 0.406572), ("d2", 0.406572), ("d3", 0.296108)]),
        ("dog", [("d10", 0.707107), ("d2", 0.707107), ("d1", 0.157512)], [("d10", 0.406572), ("d2", 0.406572), ("d1", 0.342657)]),
        ("fish fish bird", [("d3", 0.992306), ("d10", 0.184311), ("d2", 0.184311)], [("d3", 2.394079), ("d10", 0.813145), ("d2", 0.813145)]),
        ("zebra", [], []),
    ],
)
def test_rankings(spark, toy, query, cosine, bm25):
    asked = _ask(spark, query)
    assert _listed(rank.cosine_scores(toy, asked)) == cosine
    assert _listed(rank.bm25_scores(toy, asked)) == bm25


def _normalise(operands):
    import re

    return [[w for w in re.findall(r"\w+", x.lower()) if w not in STOP] for x in operands]


def test_boolean_truth_table(spark, toy):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    for query, want in TRUTH.items():
        parsed = boolean.parse(query, _normalise)
        assert " ".join(sorted(r["doc_id"] for r in boolean.search(toy.postings, docs, parsed).collect())) == want, query
        if query in POSTFIX:
            assert " ".join(v for _, v in parsed.postfix) == POSTFIX[query]
    counts = boolean.hit_counts(toy.postings, docs, list((q, q) for q in TRUTH), _normalise)
    assert {r["qid"]: r["hits"] for r in counts.collect()} == {q: len(w.split()) for q, w in TRUTH.items()}
    found = {}
    for r in boolean.search_many(toy.postings, docs, spark.createDataFrame([(q, q) for q in TRUTH], "qid string, text string"), _normalise).collect():
        found.setdefault(r["qid"], []).append(r["doc_id"])
    assert {q: " ".join(sorted(found.get(q, []))) for q in TRUTH} == TRUTH


def test_boolean_queries_of_many_terms(spark, toy):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    words = " OR ".join(f"none{k}" for k in range(150))
    for query, want in ((f"({words}) OR cat", {"d1"}), (f"NOT ({words}) AND dog", {"d1", "d2", "d10"}), (f"NOT ({words} OR cat)", {"d2", "d3", "d10"})):
        assert {r["doc_id"] for r in boolean.search(toy.postings, docs, boolean.parse(query, _normalise)).collect()} == want
    queries = [("a", f"({words}) OR cat"), ("b", f"NOT ({words}) AND dog"), ("a", "bird"), (None, "fish"), ("c", None)]
    got = boolean.hit_counts(toy.postings, docs, queries, _normalise).collect()
    assert sorted((r["qid"] or "", r["hits"]) for r in got) == [("", 3), ("a", 1), ("a", 1), ("b", 3), ("c", 0)]
    assert boolean.hit_counts(toy.postings, docs, spark.createDataFrame([], "qid string, text string"), _normalise).count() == 0


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    made = index.build(docs, "sk")
    assert tuple(made.stats.first()) == (0, 0.0)
    assert made.terms.count() == made.docs.count() == 0
    assert rank.bm25_scores(made, _ask(spark, "cat")).count() == 0
    assert index.fingerprint(docs).first()["documents"] == 0


def test_empty_documents_count_for_n(spark):
    docs = spark.createDataFrame([("a", "strom"), ("b", "!!!")], "doc_id string, text string")
    assert tuple(index.build(docs, "sk").stats.first()) == (2, 0.5)
    assert tuple(index.build(docs, "sk", drop_empty=True).stats.first()) == (1, 1.0)


def test_save_load_and_cache(spark, tmp_path):
    docs = spark.createDataFrame([("a", "strom a dom"), ("b", "dom"), ("c", "!")], "doc_id string, text string")
    path = str(tmp_path / "index")
    row = index.build(docs, "sk").save(path, docs, language="sk", source="here")
    assert (row["doc_count"], row["term_count"], row["documents"], row["language"]) == ("3", "2", "3", "sk") and int(row["index_size_bytes"]) > 0 and float(row["duration_seconds"]) > 0
    again = index.load(spark, path)
    assert {tuple(r) for r in again.postings.collect()} == {("strom", "a", 1, 2), ("dom", "a", 1, 2), ("dom", "b", 1, 1)} and again.meta == row
    assert index.is_current(spark, path, docs) and index.is_current(spark, path, docs, "here") and not index.is_current(spark, path, docs, "there")
    assert index.is_current(spark, path, docs.orderBy(F.desc("doc_id")))
    assert not index.is_current(spark, path, docs.where("doc_id = 'a'"))
    assert not index.is_current(spark, str(tmp_path / "none"), docs)
    assert {tuple(r) for r in index.rebuild(again.postings).stats.collect()} == {(2, 1.5)}
    assert [index.cached(path, d, x, "sk")[1] for d, x in ((docs, "here"), (docs, "there"), (docs, "there"), (docs.where("doc_id <> 'b'"), "there"))] == [False, True, False, True]


def test_shared_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    write = lambda rows: spark.createDataFrame(rows, "doc_id string, text string").write.mode("overwrite").parquet(path)
    write([("a", "strom"), ("b", "dom")])
    first = index.shared(spark.read.parquet(path), "sk")
    again = index.shared(spark.read.parquet(path), "sk")
    assert first.postings.inputFiles() == again.postings.inputFiles()
    assert index.shared(spark.read.parquet(path).where("doc_id = 'a'"), "sk").stats.first()["n"] == 1
    write([("a", "strom"), ("b", "dom"), ("c", "dom")])
    assert index.shared(spark.read.parquet(path), "sk").stats.first()["n"] == 3 and first.postings.count() == 2


def test_index_in_json(spark, toy, tmp_path):
    import json

    postings = {}
    for r in toy.postings.collect():
        postings.setdefault(r["term"], {})[r["doc_id"]] = r["tf"]
    lengths = {r["doc_id"]: r["dl"] for r in toy.docs.collect()}
    full = {"postings": postings, "doc_freq": {t: len(d) for t, d in postings.items()}, "idf": {r["term"]: r["idf"] for r in toy.terms.collect()}, "doc_lengths": lengths, "avgdl": 2.75, "num_docs": 4}
    forms = {"wrapped": {"meta": {"pipeline": "baseline_sk", "doc_count": 4}, "index": full}, "bare": full, "postings": {"postings": postings}, "empty": {"postings": {}}}
    for name, payload in forms.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(payload, indent=1), encoding="utf-8")
        made = index.read_json(spark, str(path))
        if name == "empty":
            assert made.postings.count() == 0 and tuple(made.stats.first()) == (0, 0.0)
            continue
        for query in ("cat fish", "dog"):
            assert _listed(rank.bm25_scores(made, _ask(spark, query))) == _listed(rank.bm25_scores(toy, _ask(spark, query)))
            assert _listed(rank.cosine_scores(made, _ask(spark, query))) == _listed(rank.cosine_scores(toy, _ask(spark, query)))
        assert made.meta.get("pipeline") == ("baseline_sk" if name == "wrapped" else None)


def test_corpus_takes_repeats_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 5, "x"), (2, None, 5, "x"), (None, "c", 5, "x"), (3, " \xa0", 5, "x")], "doc_id int, text string, tf int, term string")
    assert [tuple(r) for r in index.corpus(rows).collect()] == [("1", "b")]
    last = index.dedupe_last(rows, "doc_id", "text")
    assert last.columns == rows.columns
    assert {(r["doc_id"], r["text"]) for r in last.collect()} == {(1, "b"), (2, None), (None, "c"), (3, " \xa0")}


def test_metrics(spark):
    run = spark.createDataFrame([("q1", "a", 3.0), ("q1", "b", 2.0), ("q1", "c", 2.0), ("q2", "a", 1.0), ("q3", "z", 1.0)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("q1", "b", 1), ("q1", "x", 1), ("q1", "b", 0), ("q2", "z", 1), ("q9", "a", 1)], "qid string, doc_id string, rel int")
    got = {r["qid"]: r for r in evaluate.query_metrics(run, qrels).collect()}
    assert set(got) == {"q1", "q2"}  # equal scores: c comes before b
    assert got["q1"]["ap"] == pytest.approx(1 / 3 / 2)
    assert got["q1"]["rr"] == pytest.approx(1 / 3)
    assert got["q1"]["ndcg"] == pytest.approx((1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert got["q2"]["ap"] == got["q2"]["rr"] == 0
    assert evaluate.means(evaluate.query_metrics(run, qrels)).first()["p_at_k"] == pytest.approx(0.05)


def _python_snippet(text, terms):
    import re

    text = (text or "").strip()
    if not text:
        return snippet.NO_TEXT

    def mark(x):
        for t in sorted(terms, key=len, reverse=True):
            x = re.sub(re.escape(t), lambda m: f"[[{m.group(0)}]]", x, flags=re.IGNORECASE)
        return x

    for t in sorted(terms, key=len, reverse=True):
        at = text.lower().find(t)
        if at >= 0:
            a, b = max(0, at - 80), min(len(text), at + len(t) + 120)
            return mark(("..." if a else "") + text[a:b] + ("..." if b < len(text) else ""))
    return mark(text[:220] + ("..." if len(text) > 220 else ""))


def test_snippets(spark):
    terms = ["kraj", "cat"]
    texts = [None, " ", "Cat", "x" * 300, "a " * 100 + "KRAJ " + "b " * 100, "  cat kraj ", "concat" * 60, "\xa0kraj "]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", snippet.snippet(F.col("text"), terms).alias("s"))
    assert {r["n"]: r["s"] for r in rows.collect()} == {n: _python_snippet(t, terms) for n, t in enumerate(texts)}
    assert snippet.query_terms_of("Cat AND not dog cat") == ["cat", "dog"]


def test_display(spark):
    ranked = spark.createDataFrame([("q", "a", 1.5, 1), ("q", "b", 1.0, 2)], "qid string, doc_id string, score double, rank int")
    titles = spark.createDataFrame([("a", "t" * 40)], "doc_id string, title string")
    got = {r["doc_id"]: (r["title"], r["score"]) for r in snippet.result_table(ranked, titles).collect()}
    assert got == {"a": ("t" * 30, "1.5000"), "b": ("Unknown", "1.0000")}
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024**3,), (None,)], "n bigint").select(snippet.size_text(F.col("n")).alias("s"))
    assert [r["s"] for r in sizes.collect()] == ["0 B", "1023 B", "1.5 KB", "5.0 GB", None]
    assert rank.trec_lines(ranked, "run").first()["line"] == "q Q0 a 1 1.500000 run"
