import pytest

from glosswork.operators import engine, pipelines
from glosswork.operators.pipelines import Pipeline

DOCS = [("1", "Nové recepty z knihovnami města"), ("2", "Recept na polévku a recepty babičky"), ("3", "Stará pekárna ve městě"), ("4", "")]


def test_choice():
    assert pipelines.chosen("") == pipelines.chosen("all") == list(pipelines.NAMES)
    assert pipelines.chosen("stemming, baseline,stemming") == ["stemming", "baseline"]
    assert pipelines.named("stemming_en") == Pipeline("stemming", "en") and pipelines.named("baseline").language == "cs"
    for bad in (lambda: pipelines.chosen("x"), lambda: pipelines.named("x_cs"), lambda: pipelines.named("baseline_de")):
        with pytest.raises(ValueError):
            bad()


def test_engine(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    plain = engine.SearchEngine(docs)
    assert plain.get_document("3").startswith("Stará") and plain.get_document("9") == ""
    assert {r["doc_id"] for r in plain.search("recepty").collect()} == {"1", "2"}
    assert [r["doc_id"] for r in plain.search("recept", scorer="tfidf").collect()] == ["2"]
    assert [r["doc_id"] for r in plain.boolean_search("recepty AND NOT polevku").collect()] == ["1"]
    assert plain.explain_boolean("a AND recepty").error
    assert {r["qid"]: r["hits"] for r in plain.boolean_counts([("x", "NOT recepty"), ("y", "(")]).collect()} == {"x": 2, "y": 0}
    assert "[[recepty]]" in plain.snippets("recepty", 1).first()["snippet"]


def test_stems_and_lemmas(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    stemmed = engine.SearchEngine(docs, Pipeline("stemming", "cs"))
    assert {r["doc_id"] for r in stemmed.search("knihovna").collect()} == {"1"}
    lemmas = spark.createDataFrame([("recepty", "recept")], "form string, lemma string")
    lemmatised = engine.SearchEngine(docs, Pipeline("lemmatization", "cs"), lemmas)
    assert {r["doc_id"] for r in lemmatised.search("recept").collect()} == {"1", "2"}
    assert lemmatised.index.postings.where("term = 'recept' and doc_id = '2'").first()["tf"] == 2


def test_benchmark(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    queries = spark.createDataFrame([("q1", "recepty"), ("q2", None)], "qid string, text string")
    qrels = spark.createDataFrame([("q1", "1", 1), ("q1", "2", 1)], "qid string, doc_id string, rel int")
    result = engine.run_benchmark(docs, queries, qrels)
    assert result["map"] == 1.0 and result["rows"] == 2
    report = engine.benchmark_report([result])
    assert "| cs | baseline | bm25 | 1.0000 |" in report
