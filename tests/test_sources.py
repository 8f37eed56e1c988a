import json

import pytest
from pyspark.sql import functions as F

from glosswork.functions import html as H
from glosswork.functions.text import site_of
from glosswork.operators.graph import components
from glosswork.sources import crawl, records
from glosswork.streaming import ingest


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "text": "x"}, {"id": 2, "text": "y"}], indent=1))
    (tmp_path / "b.jsonl").write_text('{"id": 1, "text": "x"}\n{"id": 2, "text": "y"}\n')
    (tmp_path / "c.json").write_text('{"id": 1, "text": "x"}\n{"id": 2, "text": "y"}\n')
    (tmp_path / "d.jsonl").write_text('{"id": 1, "text": "x"}\nbroken\n')
    (tmp_path / "e.json").write_text(json.dumps([{"id": 1, "text": "x"}, {"id": 2, "text": "y"}]))
    (tmp_path / "f.json").write_text(json.dumps({"id": 1, "text": "x"}, indent=1))
    assert [(r["id"], r["text"]) for r in records.read_records(spark, str(tmp_path / "f.json")).collect()] == [(1, "x")]
    for name in ("a.json", "b.jsonl", "c.json", "e.json"):
        assert {(r["id"], r["text"]) for r in records.read_records(spark, str(tmp_path / name)).collect()} == {(1, "x"), (2, "y")}, name
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "d.jsonl")).collect()
    assert [r["id"] for r in records.read_records(spark, str(tmp_path / "d.jsonl"), lenient=True).select("id", "text").collect()] == [1]
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "none.json")).collect()


def test_collection_and_query_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("d1: cat: dog\n\nD2: fish\nQ1: cat\n")
    got = records.read_collection(spark, str(tmp_path / "c.txt"))
    assert {tuple(r) for r in got.documents.collect()} == {("d1", "cat: dog"), ("D2", "fish")}
    assert [tuple(r) for r in got.queries.collect()] == [("Q1", "cat")]
    assert records.looks_like_collection(str(tmp_path / "c.txt"))
    (tmp_path / "vocab.txt").write_text("d1: x\n")
    assert not records.looks_like_collection(str(tmp_path / "vocab.txt"))
    (tmp_path / "bad.txt").write_text("d1: cat\nother 5\n")
    with pytest.raises(Exception):
        records.read_collection(spark, str(tmp_path / "bad.txt")).documents.collect()
    (tmp_path / "q.txt").write_text("cat AND dog\n\n NOT cat \n")
    assert {tuple(r) for r in records.read_queries(spark, str(tmp_path / "q.txt")).collect()} == {("q1", "cat AND dog"), ("q3", "NOT cat")}


def test_keys_ids_and_text(spark):
    rows = spark.createDataFrame([(1, "0", "u", " a ", None, 7), (2, None, None, " ", "b", 7), (3, "x", "u", "", " ", 7)], "n int, doc_id string, url string, title string, body string, text_count int")
    assert [(r["key"], r["filled"]) for r in records.detect_text_keys(rows).orderBy(F.desc("filled"), "key").collect()] == [("doc_id", 2), ("url", 2), ("body", 1), ("title", 1)]
    got = {r["id"]: r["text"] for r in records.normalise_documents(rows, ["title", "body", "url"], "n").collect()}
    assert got == {"u": "a", "doc_2": "b"}
    assert {tuple(r) for r in records.evaluation_documents(rows, "n").collect()} == {("0", "a"), ("d2", "b")}
    assert records.choose_text_keys(["id", "text"], ["id", "text"]) == ["text"]
    assert records.choose_text_keys(["id", "note"], ["id", "note"]) == ["note"]
    with pytest.raises(ValueError):
        records.choose_text_keys(["id"], ["id"], ["none"])


def test_metadata(spark):
    rows = spark.createDataFrame([(1, "a", "u1", "old"), (2, "a", "u2", "new"), (3, None, None, None)], "n int, doc_id string, url string, title string")
    got = {r["key"]: (r["title"], r["url"]) for r in records.metadata(rows, "n").collect()}
    assert got == {"a": ("new", "u2"), "u1": ("old", "u1"), "u2": ("new", "u2"), "doc_3": ("Unknown", None)}
    one = records.metadata(rows, "n")
    two = spark.createDataFrame([("a", "other", None), ("b", "more", "ub")], "key string, title string, url string")
    merged = {r["key"]: r["title"] for r in records.merged_metadata(one, two).collect()}
    assert merged["a"] == "new" and merged["b"] == "more"


def test_writers(spark, tmp_path):
    records.write_vocabulary(spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "term string, freq bigint").coalesce(1), str(tmp_path / "v"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["c 5", "a 2", "b 2"]
    docs = spark.createDataFrame([("1", "1", None, ["é"], "é")], "id string, doc_id string, url string, tokens array<string>, normalized_text string")
    records.write_preprocessed(docs, str(tmp_path / "p"))
    assert records.preprocessed_texts(spark.read.json(str(tmp_path / "p")).withColumn("n", F.lit(1)), "n").first()["text"] == "é"


HTML = """<html><head><title> A &amp; B </title><meta content="Jo" name="author"></head><body><a class="x topic" href="/t">Veda</a>
<time class="entry-date" datetime="2020-01-01"></time><a href="/t">t</a><a href='https://s.sk/p?a=1&amp;b=2'>l</a>
<article id="clanok"> <p>Prvý <b>tučný</b> text.</p><br><p> Druhý </p><script>x</script></article><p>Mimo</p></body></html>"""


def test_html(spark):
    rows = spark.createDataFrame([(1, "u", HTML), (2, "v", "<p>nothing</p>"), (3, "w", None)], "page_id int, url string, html string")
    got = {r["url"]: r for r in crawl.records(rows).collect()}
    assert (got["u"]["title"], got["u"]["author"], got["u"]["topic"], got["u"]["publication_date"]) == ("A & B", "Jo", "Veda", "2020-01-01")
    assert got["u"]["article_text"] == "Prvýtučnýtext.Druhýx"
    assert (got["v"]["title"], got["v"]["article_text"]) == (H.NO_TITLE, H.NO_ARTICLE)
    assert got["w"]["hashed_content"] is None
    links = {r["url"] for r in crawl.page_links(rows).collect()}
    assert links == {"/t", "https://s.sk/p?a=1&b=2"}
    kept = crawl.allowed_links(crawl.page_links(rows), "https://s.sk", ["/x", ""])
    assert [r["url"] for r in kept.collect()] == ["https://s.sk/p?a=1&b=2"]
    assert crawl.allowed_links(crawl.page_links(rows), "https://s.sk", ["/p"]).count() == 0


def test_crawl_files(spark):
    site = spark.createDataFrame([("s", "<x>\n <loc>https://a</loc> \n<loc>open\n"), ("t", None)], "source string, body string")
    assert [r["url"] for r in crawl.sitemap_urls(site).collect()] == ["https://a"]
    robots = spark.createDataFrame([("s", "User-agent: *\nDisallow: /a\nCrawl-delay: 5\nX: y")], "source string, body string")
    assert [(r["rule"], r["value"]) for r in crawl.robots_rules(robots).collect()] == [("Disallow", "/a"), ("Crawl-delay", "5")]
    found = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",)], "url string")
    front = spark.createDataFrame([("b",), (None,)], "url string")
    assert [r["url"] for r in crawl.new_urls(found, front).collect()] == ["a"]


def test_sites(spark):
    urls = ["HTTPS://WWW.A.example:443/x", "http://a.example", "//www.a.example/y", "a.example/z", None, "", "https://u:p@a.example/"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(site_of(F.col("url")).alias("s")).collect()
    assert [r["s"] for r in got] == ["a.example"] * 4 + [None, None, "a.example"]


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 120)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 200: 120, 150: 120, 120: 120}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_components_against_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"doc_id": "a", "text": "dom strom", "scraped_at": "2024-01-01T00:00:00", "url": "u"}\n{"doc_id": "b", "text": "dom", "scraped_at": "2024-01-01T01:00:00", "url": "u"}\n')
    schema = "doc_id string, text string, scraped_at timestamp, url string, topic string"
    run = lambda: ingest.index_stream(ingest.page_stream(spark, str(folder), schema).select("doc_id", "text"), str(tmp_path / "post"), str(tmp_path / "ck"), "sk").awaitTermination()
    run()
    (folder / "2.json").write_text('{"doc_id": "a", "text": "les", "scraped_at": "2024-01-02T00:00:00", "url": "v"}\n')
    run()
    assert {tuple(r) for r in ingest.latest_postings(spark, str(tmp_path / "post")).collect()} == {("les", "a", 1), ("dom", "b", 1)}
    query = ingest.first_seen(ingest.page_stream(spark, str(folder), schema)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["url"] for r in spark.table("seen").collect()) == ["u", "v"]
    counts = ingest.topic_counts(ingest.page_stream(spark, str(folder), schema)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert sorted(r["pages"] for r in spark.table("counts").collect()) == [1, 2]
