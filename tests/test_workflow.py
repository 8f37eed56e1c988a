"""Runs over files: collections, preprocessing and its metadata, evaluation, crawl state."""

import json

import pytest
from pyspark.sql import functions as F

from glosswork.operators import engine, index, workflow
from glosswork.operators.pipelines import Pipeline
from glosswork.sources import crawl, records

COLLECTION = "d1: cat dog cat\nd2: dog fish\nd3: fish bird bird bird\nd10: dog fish\n\nq1: cat fish\nq2: zebra\nq3: dog AND NOT cat\n"
DOCS = [("1", "Nové recepty z knihovnami města"), ("2", "Recept na polévku a recepty babičky"), ("3", "Stará pekárna ve městě"), ("4", "")]


def test_collection_run(spark, tmp_path):
    path, at = tmp_path / "toy.txt", str(tmp_path / "index")
    path.write_text(COLLECTION, encoding="utf-8")
    runs = [workflow.run_collection(spark, str(path), at) for _ in range(2)]
    assert [r.built for r in runs] == [True, False] and runs[0].name == "toy"
    for run in runs:
        assert {r["term"]: (r["df"], r["idf"]) for r in run.terms.collect()} == {"cat": (1, 0.60206), "bird": (1, 0.60206), "dog": (3, 0.124939), "fish": (3, 0.124939)}
        assert [(r["doc_id"], r["score"]) for r in run.ranking.where("qid = 'q1'").orderBy("rank").collect()] == [("d1", 0.966917), ("d10", 0.143677), ("d2", 0.143677), ("d3", 0.028268)]
        assert run.ranking.where("qid = 'q2'").count() == 0
        norm = {r["doc_id"]: r["s"] for r in run.vectors.groupBy("doc_id").agg(F.round(F.sum(F.pow("normalised", 2)), 4).alias("s")).collect()}
        assert norm == {"d1": 1.0, "d2": 1.0, "d3": 1.0, "d10": 1.0} and run.query_vectors.where("qid = 'q1'").count() == 2
    path.write_text(COLLECTION.replace("d2: dog", "d2: cat"), encoding="utf-8")
    assert workflow.run_collection(spark, str(path), at).built
    other = tmp_path / "other.txt"
    other.write_text(COLLECTION.replace("d2: dog", "d2: cat"), encoding="utf-8")
    assert workflow.run_collection(spark, str(other), at).built


def test_boolean_collection_run(spark, tmp_path):
    path = tmp_path / "toy.txt"
    path.write_text(COLLECTION, encoding="utf-8")
    got = sorted((r["qid"], r["doc_id"]) for r in workflow.run_boolean_collection(spark, str(path)).collect())
    assert got == [("q1", d) for d in ("d1", "d10", "d2", "d3")] + [("q3", "d10"), ("q3", "d2")]
    (tmp_path / "q.txt").write_text("NOT dog\n\n(cat\n", encoding="utf-8")
    asked = records.boolean_queries(spark, str(tmp_path / "q.txt"))
    assert [(r["qid"], r["doc_id"]) for r in workflow.run_boolean_collection(spark, str(path), asked).collect()] == [("bq1", "d3")]


def test_open_saved_index(spark, tmp_path):
    docs, path = spark.createDataFrame(DOCS, "doc_id string, text string"), str(tmp_path / "index")
    first = engine.SearchEngine(docs, Pipeline("stemming", "cs"))
    first.save(path, source="here")
    again = engine.SearchEngine.open(spark, path)
    assert again.pipeline == Pipeline("stemming", "cs") and again.index.meta["source"] == "here"
    assert again.search("knihovna").collect() == first.search("knihovna").collect()
    assert again.get_document("1") == "" and engine.SearchEngine.open(spark, path, docs).get_document("1").startswith("Nové")
    assert {r["doc_id"] for r in again.boolean_search("NOT knihovna").collect()} == {"2", "3"}  # 4 has no term
    assert {r["doc_id"] for r in first.boolean_search("NOT knihovna").collect()} == {"2", "3", "4"}
    assert first.explain_boolean("NOT knihovna").hits == 3 and first.explain_boolean("(").hits == 0
    assert {(r["qid"], r["doc_id"]) for r in again.boolean_search_all([("a", "knihovna"), ("b", "(")]).collect()} == {("a", "1")}
    assert again.snippets("knihovna", 1).first()["snippet"].startswith("[no text")
    built = [engine.open_or_build(spark, path, d, s, p)[1] for d, s, p in ((docs, "here", Pipeline("stemming", "cs")), (docs, "here", Pipeline()), (docs, "there", Pipeline()), (docs, "there", Pipeline()))]
    assert built == [False, True, True, False]


def test_evaluation_summary(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    queries = spark.createDataFrame([("q1", "recepty"), ("q2", None)], "qid string, text string")
    qrels = spark.createDataFrame([("q1", "1", 1), ("q1", "2", 1)], "qid string, doc_id string, rel int")
    (tmp_path / "b.txt").write_text("recepty AND NOT polevku\n\n(recepty\n", encoding="utf-8")
    got = engine.evaluation(docs, queries, str(tmp_path), qrels, records.boolean_queries(spark, str(tmp_path / "b.txt")), dataset="toy")
    assert got["meta"]["dataset"] == "toy" and (got["meta"]["query_count"], got["meta"]["document_count"]) == (2, 4)
    assert got["quality"]["map"] == 1.0 and got["boolean"] == {"enabled": True, "hit_counts": {"bq1": 1, "bq3": 0}}
    assert got["thresholds"] == {"indexing": True, "ranked": True} and set(got["timing_seconds"]) == {"indexing", "ranked", "boolean"}
    assert sorted(r["value"].split()[2] for r in spark.read.text(got["artifacts"]["run"]).collect()) == ["1", "2"]
    records.write_summary(str(tmp_path / "s.json"), **got)
    assert json.loads((tmp_path / "s.json").read_text())["boolean"]["hit_counts"]["bq1"] == 1
    bare = engine.evaluation(docs, queries, str(tmp_path))
    assert bare["quality"] is None and bare["boolean"]["hit_counts"] is None and bare["timing_seconds"]["boolean"] is None


def test_preprocessing_run_and_its_context(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "u", "Nové recepty", "Knihovnami města a recepty"), (2, None, None, None, " "), (3, None, None, "Dom", None)], "n int, id string, url string, title string, article_text string")
    folder = str(tmp_path / "out")
    lemmas = spark.createDataFrame([("recepty", "recept")], "form string, lemma string")
    row = workflow.preprocess(rows, "n", folder, "baseline,lemmatization", "cs", ["title", "article_text"], source="in.jsonl", lemmas=lemmas)
    assert (row["document_count"], row["pipelines"], row["text_keys"]) == (2, ["baseline", "lemmatization"], ["title", "article_text"])
    docs = {r["doc_id"]: r for r in spark.read.json(row["docs"][0]).collect()}
    assert docs["a"]["normalized_text"] == "nove recepty knihovnami mesta recepty" and docs["doc_3"]["tokens"] == ["dom"]
    assert {r["doc_id"]: r["normalized_text"] for r in spark.read.json(row["docs"][1]).collect()}["a"] == "nove recept knihovnami mesta recept"
    vocabulary = [r["value"] for r in spark.read.text(row["vocabularies"][0]).collect()]
    assert vocabulary[0] == "recepty 2" and [r["value"] for r in spark.read.text(f"{folder}/vocab").collect()] == vocabulary
    assert workflow.preprocessing_context(spark, row["docs"][1]) == {"input_path": "in.jsonl", "language": "cs", "text_keys": ["title", "article_text"]}
    workflow.preprocess(rows, "n", folder, "baseline", "sk", source="again.jsonl", write_vocabulary=False)
    assert workflow.preprocessing_context(spark, f"{folder}/docs_baseline_sk")["text_keys"] == ["article_text"]
    assert workflow.preprocessing_context(spark, f"{folder}/none") is None and workflow.preprocessing_context(spark, str(tmp_path / "x" / "y")) is None
    meta = workflow.index_preprocessed(spark, row["docs"][0], str(tmp_path / "index"), "baseline_cs")
    assert (meta["pipeline"], meta["doc_count"], meta["source"]) == ("baseline_cs", "2", row["docs"][0]) and int(meta["input_size_bytes"]) > 0
    opened = engine.SearchEngine.open(spark, str(tmp_path / "index"))
    assert [r["doc_id"] for r in opened.search("knihovnami", scorer="tfidf").collect()] == ["a"]
    assert index.load(spark, str(tmp_path / "index")).postings.where("term = 'recepty'").first()["tf"] == 2
    found = records.discover(spark, folder, "docs_*")
    assert [x.rpartition("/")[2] for x in found] == ["docs_baseline_cs", "docs_baseline_sk", "docs_lemmatization_cs"]
    assert records.discover(spark, str(tmp_path / "nothing")) == [] and len(records.discover(spark, str(tmp_path), "part-*.json", recursive=True)) >= 3
    with pytest.raises(ValueError):
        workflow.index_preprocessed(spark, _empty(spark, tmp_path), str(tmp_path / "no"))


def _empty(spark, tmp_path):
    spark.createDataFrame([("a", "a", " ")], "id string, doc_id string, normalized_text string").write.json(str(tmp_path / "blank"))
    return str(tmp_path / "blank")


def test_query_commands_and_lenient_reading(spark, tmp_path):
    (tmp_path / "q.txt").write_text("cat\n\n dog AND x \n", encoding="utf-8")
    assert [tuple(r) for r in records.query_command(spark, f"FILE: {tmp_path}/q.txt").collect()] == [("q1", "cat"), ("q3", "dog AND x")]
    assert records.query_command(spark, "cat file:x") is None
    with pytest.raises(ValueError):
        records.query_command(spark, "file: ")
    assert records.read_records(spark, str(tmp_path / "none.json"), lenient=True).count() == 0


def test_crawl_metadata(spark):
    rows = spark.createDataFrame([(1, "u", "old", "x", "t"), (2, "u", None, None, "text"), (3, None, "a", "b", "c"), (4, "v", "T", "A", " ")], "n int, url string, title string, author string, article_text string")
    assert {tuple(r) for r in records.crawl_metadata(rows, "n").collect()} == {("u", "No title", "", "text"), ("v", "T", "A", None)}


def test_nested_sitemaps(spark):
    line = lambda *urls: "\n".join(f"<loc>{u}</loc>" for u in urls)
    files = [("s/sitemap", line("s/SITEMAP1", "s/a", "t/other", "s/no/x")), ("s/SITEMAP1", line("s/b", "s/sitemap", "s/sitemap2")), ("s/sitemap2", line("s/c", "s/b")), ("x", None)]
    bodies = spark.createDataFrame(files, "source string, body string")
    roots = spark.createDataFrame([("s/sitemap",), (None,)], "url string")
    assert sorted(r["url"] for r in crawl.sitemap_tree(bodies, roots, "s/").collect()) == ["s/a", "s/b", "s/c", "s/no/x"]
    assert crawl.sitemap_tree(bodies, roots.where("false")).count() == 0


def test_crawl_rounds_and_state(spark, tmp_path):
    page = lambda k, url, *links: (k, url, "<title>T</title>" + "".join(f'<a href="{u}">x</a>' for u in links))
    pages = spark.createDataFrame([page(1, "https://s/a", "https://s/b", "https://t/c", "https://s/no/d"), page(2, "https://s/b", "https://s/a", "https://s/e")], "page_id int, url string, html string")
    frontier = spark.createDataFrame([("https://s/a", "pending"), ("https://s/gone", "PENDING"), ("https://t/x", "pending"), ("https://s/z", "visited"), (None, "pending"), ("https://t/y", None)], "url string, status string")
    found, frontier = crawl.crawl_round(frontier, pages, "https://s", ["/no"])
    assert [r["url"] for r in found.collect()] == ["https://s/a"]
    assert {tuple(r) for r in frontier.collect()} == {("https://s/a", "visited"), ("https://s/z", "visited"), ("https://s/b", "pending")}
    path = str(tmp_path / "state")
    assert crawl.load_state(spark, path)[0].count() == 0
    crawl.save_state(frontier, path, disallowed=["/no"], request_delay=5)
    loaded, settings = crawl.load_state(spark, path)
    assert settings == {"allowed_paths": [], "disallowed_paths": ["/no"], "request_delay": 5}
    more, frontier = crawl.crawl_round(loaded, pages, "https://s", settings["disallowed_paths"])
    crawl.save_state(frontier, path)
    assert {r["url"] for r in crawl.load_state(spark, path)[0].where("status = 'pending'").collect()} == {"https://s/e"}
    crawl.append_records(found, str(tmp_path / "records"))
    crawl.append_records(more, str(tmp_path / "records"))
    kept = spark.read.json(str(tmp_path / "records"))
    assert sorted(r["url"] for r in kept.collect()) == ["https://s/a", "https://s/b"] and kept.first()["scraped_at"][4] == "-"
    (tmp_path / "old.json").write_text(json.dumps({"pending_urls": ["a"], "visited_urls": ["b"], "request_delay": 3}, indent=1))
    queue, settings = crawl.load_state(spark, str(tmp_path / "old.json"))
    assert {tuple(r) for r in queue.collect()} == {("a", "pending"), ("b", "visited")} and settings["request_delay"] == 3


def test_folders_are_released(spark):
    from glosswork import session

    kept = session.new_folder(spark, "other")
    spark.range(3).write.parquet(kept)
    table = session.written(spark.range(3))
    path = table.inputFiles()[0].rpartition("/")[0]
    assert table.count() == 3 and session.exists(spark, path)
    session.release("table")
    assert not session.exists(spark, path) and session.exists(spark, kept)
    session.release("other")
    assert not session.exists(spark, kept)
