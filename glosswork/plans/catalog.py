"""Named queries over the driver's tables, one per operator or a few close ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import analyze as A
from glosswork.functions import html as H
from glosswork.functions.text import has_text
from glosswork.operators import boolean, evaluate, index, rank, snippet, workflow
from glosswork.operators.engine import SearchEngine
from glosswork.operators.pipelines import Pipeline
from glosswork.session import new_folder, table, text_table
from glosswork.sources import crawl, records
from glosswork.streaming import ingest

LANGUAGE = "sk"
SEARCH = "úsporné riešenia v susednom kraji"
LEMMAS = [("riesenia", "riesenie"), ("recepty", "recept"), ("recepty", "recepta"), ("pravidiel", "pravidlo"), ("rodinu", "rodina"), ("koncerty", "koncert")]
BOOLEAN = {
    "bool_and": "recepty AND koncerty",
    "bool_or": "recepty or koncerty",
    "bool_not": "NOT recepty",
    "bool_precedence": "recepty OR koncerty AND NOT rodinu",
    "bool_implicit_or": "recepty koncerty (technologie)(vysledky)",
}
BATCH = [("b1", "recepty AND koncerty"), ("b2", "NOT recepty"), ("b3", "recepty AND (koncerty"), ("b4", "technologie NOT rodinu"), ("b5", "nikdenic")]
MARKS = ["riesenia", "riešenia", "kraji"]
START, FORBIDDEN = "https://", ["/sport/", "/recepty/"]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return index.unique_corpus(text_table(spark, d, "documents", "doc_id"))


def _index(spark: SparkSession, d: str) -> index.Index:
    """The index of the documents; one for all queries of a session."""
    return index.shared(_documents(spark, d), LANGUAGE)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return rank.query_terms(table(spark, d, "eval_queries"), LANGUAGE, text="description")


def _one(spark: SparkSession, query: str = SEARCH) -> DataFrame:
    return rank.query_terms(spark.createDataFrame([("q", query)], "qid string, text string"), LANGUAGE)


def tokenize_typed(spark: SparkSession, d: str) -> DataFrame:
    return A.typed_tokens(text_table(spark, d, "documents", "doc_id"), "doc_id", "text")


def simple_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(A.plain_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def split_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return A.split_tokens(table(spark, d, "documents"), "doc_id", "title", " ")


def whitespace_tokenize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "preprocessed_docs")
    return docs.select("row_id", F.size(A.space_terms(F.coalesce("normalized_text", F.lit("")))).alias("tokens"))


def token_type_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = A.content_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.explode(kept).alias("token")).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("forms"))


def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    from glosswork.resources import STOPWORDS

    words = table(spark, d, "documents").select(F.explode(A.plain_terms(F.col("text"))).alias("word"))
    return words.where(~F.col("word").isin(STOPWORDS[LANGUAGE]) & ~A.strip_accents(F.col("word")).isin(STOPWORDS[LANGUAGE])).groupBy("word").agg(F.count("*").alias("n"))


def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.explode(A.plain_terms(F.col("text"))).alias("word"))
    return words.where(F.length("word") >= 2).groupBy("doc_id").agg(F.count("*").alias("n"))


def strip_diacritics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", A.strip_accents(F.lower("title")).alias("folded"))


def terms_baseline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(A.terms(F.col("text"), LANGUAGE)).alias("n", "term"))


def stem_cs(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(A.terms(F.col("text"), "cs")).alias("term")).distinct()
    return words.select("term", A.stem_czech(F.col("term")).alias("stem"))


def lemma_lookup(spark: SparkSession, d: str) -> DataFrame:
    lemmas = spark.createDataFrame(LEMMAS, "form string, lemma string")
    found = A.lemmatise(_documents(spark, d).select("doc_id", F.explode(A.terms(F.col("text"), LANGUAGE)).alias("term")), F.broadcast(lemmas))
    return found.groupBy("lemma").agg(F.count("*").alias("n"))


def preprocess(spark: SparkSession, d: str) -> DataFrame:
    """Preprocessed records, as the JSON-lines writer takes them."""
    terms = A.terms(F.col("article_text"), LANGUAGE)
    pages = text_table(spark, d, "crawled_pages", "page_id").where(has_text(F.col("article_text")))
    return pages.select(F.col("page_id").cast("string").alias("doc_id"), "url", terms.alias("tokens")).select("doc_id", "url", F.array_join("tokens", " ").alias("normalized_text"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return index.vocabulary(_documents(spark, d), LANGUAGE)


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings_of(_documents(spark, d), LANGUAGE)


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).docs.select("doc_id", "dl", F.round("norm", 6).alias("norm"))


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    made = index.rebuild(postings(spark, d))
    return made.docs.select("doc_id", "dl", F.round("norm", 6).alias("norm"))


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The index built, saved in the shared folder and loaded again: one row per table."""
    path = new_folder(spark, "index")
    documents = _documents(spark, d)
    index.build(documents, LANGUAGE).save(path, documents, language=LANGUAGE)
    loaded = index.load(spark, path)
    current = index.is_current(spark, path, documents)
    parts = [t.agg(F.count("*").alias("size")).select(F.lit(n).alias("part"), "size", F.lit(current).alias("current")) for n, t in (("postings", loaded.postings), ("terms", loaded.terms), ("docs", loaded.docs), ("stats", loaded.stats))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """A saved index opened by path and searched for a batch by cosine."""
    path = new_folder(spark, "index")
    SearchEngine(_documents(spark, d), Pipeline("baseline", LANGUAGE)).save(path, source=d)
    asked = table(spark, d, "eval_queries").select("qid", F.col("description").alias("text"))
    return SearchEngine.open(spark, path).search_all(asked, 10, "tfidf")


def index_meta(spark: SparkSession, d: str) -> DataFrame:
    """The counts in the metadata of a saved index."""
    path = new_folder(spark, "index")
    row = index.build(_documents(spark, d), LANGUAGE).save(path, _documents(spark, d), language=LANGUAGE)
    return spark.createDataFrame([(int(row["doc_count"]), int(row["term_count"]), int(row["documents"]), row["fingerprint"])], "doc_count bigint, term_count bigint, documents bigint, fingerprint string")


def preprocessed_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents preprocessed to files, indexed from these, and searched through the index that was saved."""
    folder = new_folder(spark, "preprocessed")
    rows = text_table(spark, d, "documents", "doc_id").withColumn("n", F.col("doc_id"))
    row = workflow.preprocess(rows, "n", folder, "baseline", LANGUAGE, ["text"], write_vocabulary=False)
    workflow.index_preprocessed(spark, row["docs"][0], f"{folder}/index", f"baseline_{LANGUAGE}")
    asked = table(spark, d, "eval_queries").select("qid", F.col("description").alias("text"))
    return SearchEngine.open(spark, f"{folder}/index").search_all(asked, 10, "tfidf")


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return index.fingerprint(_documents(spark, d))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(rank.bm25_scores(_index(spark, d), _one(spark)), 10).select("doc_id", "score", "rank")


def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(rank.cosine_scores(_index(spark, d), _one(spark)), 10).select("doc_id", "score", "rank")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(rank.bm25_scores(_index(spark, d), _asked(spark, d)), 10)


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(rank.cosine_scores(_index(spark, d), _asked(spark, d)), 10)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return rank.candidates(_index(spark, d), _asked(spark, d))


def term_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rank.term_breakdown(_index(spark, d), _asked(spark, d))


def trec_run(spark: SparkSession, d: str) -> DataFrame:
    return rank.trec_lines(rank.top_k(rank.bm25_scores(_index(spark, d), _asked(spark, d)), 1000), "bm25")


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The batch over a Czech index with stems."""
    made = index.build(_documents(spark, d), "cs", stem=True)
    return rank.top_k(rank.bm25_scores(made, rank.query_terms(table(spark, d, "eval_queries"), "cs", True, text="description")), 10)


def _boolean(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        parsed = boolean.parse(BOOLEAN[name], boolean.analyser(spark, LANGUAGE))
        return boolean.search(_index(spark, d).postings, _documents(spark, d), parsed)

    return run


def bool_malformed(spark: SparkSession, d: str) -> DataFrame:
    return boolean.search(_index(spark, d).postings, _documents(spark, d), boolean.parse("recepty AND (koncerty", boolean.analyser(spark, LANGUAGE)))


def bool_batch(spark: SparkSession, d: str) -> DataFrame:
    return boolean.hit_counts(_index(spark, d).postings, _documents(spark, d), BATCH, boolean.analyser(spark, LANGUAGE))


def _alternatives(spark: SparkSession, d: str) -> DataFrame:
    """(qid, text): the descriptions of all queries, without operators, and each once more with NOT before it."""
    plain = table(spark, d, "eval_queries").select("qid", F.regexp_replace("description", r"(?i)\b(?:and|or|not)\b|[()]", " ").alias("text"))
    return plain.union(plain.select(F.concat("qid", F.lit("-not")), F.concat(F.lit("NOT ("), "text", F.lit(")"))))


def bool_queries(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a table of Boolean queries: all descriptions, and all of them negated."""
    return boolean.hit_counts(_index(spark, d).postings, _documents(spark, d), _alternatives(spark, d), boolean.analyser(spark, LANGUAGE))


def bool_results(spark: SparkSession, d: str) -> DataFrame:
    """The documents that meet each of these queries."""
    return boolean.search_many(_index(spark, d).postings, _documents(spark, d), _alternatives(spark, d), boolean.analyser(spark, LANGUAGE))


def highlight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", snippet.highlight(F.col("title"), MARKS).alias("marked"))


def kwic(spark: SparkSession, d: str) -> DataFrame:
    return text_table(spark, d, "documents", "doc_id").select("doc_id", snippet.snippet(F.col("text"), MARKS).alias("snippet"))


def ranked_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of the three best documents."""
    best = rank.top_k(rank.bm25_scores(_index(spark, d), _one(spark)), 3)
    return snippet.with_snippets(best, _documents(spark, d), MARKS).select("rank", "doc_id", "snippet")


def _numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    return pages.select(F.col("page_id").alias("n"), "url", "title", F.col("article_text").alias("text"))


def metadata_enrich(spark: SparkSession, d: str) -> DataFrame:
    return records.metadata(_numbered_pages(spark, d), "n")


def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of the documents, completed by that of the pages."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("doc_id"), "title")
    return records.merged_metadata(records.metadata(docs, "n"), records.metadata(_numbered_pages(spark, d), "n"))


def crawl_metadata(spark: SparkSession, d: str) -> DataFrame:
    return records.crawl_metadata(table(spark, d, "crawled_pages"), "page_id")


def snippet_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of preprocessed records to cut snippets from."""
    rows = table(spark, d, "preprocessed_docs")
    return rows.select("row_id", records.snippet_texts(rows.columns).alias("text"))


def results_display(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "title")
    return snippet.result_table(bm25_topk(spark, d), titles)


def get_document(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 1").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Quality of BM25 to a depth of 1000, where documents that hold all terms of the query count as relevant."""
    asked = _asked(spark, d)
    needed = asked.groupBy("qid").agg(F.count("*").alias("needed"))
    held = _index(spark, d).postings.join(rank.small(asked.select("qid", "term")), "term").groupBy("qid", "doc_id").agg(F.count("*").alias("held"))
    qrels = held.join(rank.small(needed), "qid").where("held = needed").select("qid", "doc_id", F.lit(1).alias("rel"))
    per = evaluate.query_metrics(rank.top_k(rank.bm25_scores(_index(spark, d), asked), 1000), qrels)
    return per.select("qid", *(F.round(c, 6).alias(c) for c in ("ap", "p_at_k", "ndcg", "rr")))


def eval_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.means(eval_metrics(spark, d))


def detect_text_keys(spark: SparkSession, d: str) -> DataFrame:
    return records.detect_text_keys(table(spark, d, "crawled_pages").orderBy("page_id"))


def normalize_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_pages").withColumn("n", F.col("page_id"))
    return records.normalise_documents(rows, ["title", "article_text", "url"], "n")


def evaluation_docs(spark: SparkSession, d: str) -> DataFrame:
    return records.evaluation_documents(table(spark, d, "preprocessed_docs"), "row_id")


def evaluation_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_queries").withColumn("n", F.substring("qid", 2, 9).cast("bigint"))
    return records.evaluation_queries(rows, "n")


def preprocessed_texts(spark: SparkSession, d: str) -> DataFrame:
    return records.preprocessed_texts(table(spark, d, "preprocessed_docs"), "row_id")


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return index.dedupe_last(table(spark, d, "preprocessed_docs"), "doc_id", "row_id").select("row_id", "doc_id", "pipeline")


def size_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", snippet.size_text(F.pow(F.col("n_chars"), 3)).alias("size"))


def content_md5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_pages").select("page_id", F.md5(F.col("article_text")).alias("md5"))


def _escaped(value: str) -> F.Column:
    out = F.col(value)
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def _html(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, html): the pages written as HTML, as the tables hold none."""
    part = lambda before, value, after: F.coalesce(F.concat(F.lit(before), _escaped(value), F.lit(after)), F.lit(""))
    text = F.coalesce(F.concat(F.lit('<article id="clanok"><p>'), F.replace(_escaped("article_text"), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p></article>")), F.lit(""))
    html = F.concat(
        F.lit("<html><head>"),
        part("<title>", "title", "</title>"),
        part('<meta name="author" content="', "author", '">'),
        F.lit("</head><body>"),
        part('<a class="topic" href="/t">', "topic", "</a>"),
        part('<time class="entry-date" datetime="', "publication_date", '"></time>'),
        part('<a href="', "url", '">more</a><a href="/t">again</a>'),
        text,
        F.lit("</body></html>"),
    )
    return text_table(spark, d, "crawled_pages", "page_id").select("page_id", "url", html.alias("html"))


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("page_id", H.title(F.col("html")).alias("title"))


def html_fields(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("html")
    return _html(spark, d).select("page_id", H.author(page).alias("author"), H.topic(page).alias("topic"), H.publication_date(page).alias("publication_date"))


def html_article(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("page_id", H.article_text(F.col("html")).alias("article_text"))


def html_records(spark: SparkSession, d: str) -> DataFrame:
    return crawl.records(_html(spark, d).where("url is not null")).select("url", "title", "hashed_content")


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return crawl.page_links(_html(spark, d))


def link_filter(spark: SparkSession, d: str) -> DataFrame:
    return crawl.allowed_links(crawl.page_links(_html(spark, d)), START, FORBIDDEN)


def frontier_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return crawl.new_urls(table(spark, d, "crawled_pages"), table(spark, d, "frontier"))


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<urlset>\n <loc>"), F.col("url"), F.lit("</loc>\n<loc>broken\n</urlset>"))
    return crawl.sitemap_urls(table(spark, d, "frontier").select(F.col("entry_id").alias("source"), body.alias("body")))


def _maps(spark: SparkSession, d: str) -> DataFrame:
    """(source, body): sitemaps in a tree, each naming two more and the urls of some entries of the frontier; the last ones name the first again."""
    urls = table(spark, d, "frontier").select(F.pmod("entry_id", F.lit(31)).alias("at"), F.concat(F.lit("<loc>"), "url", F.lit("</loc>")).alias("line")).where("url <> '' and not contains(url, '\n')")
    own = urls.groupBy("at").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("own"))
    name = lambda k: F.concat(F.lit("https://m/sitemap"), F.pmod(k, F.lit(31)))
    nested = F.concat(F.lit("<loc>"), name(2 * F.col("id") + 1), F.lit("</loc>\n<loc>"), name(2 * F.col("id") + 2), F.lit("</loc>\n"))
    return spark.range(31).join(own, F.col("id") == F.col("at"), "left").select(name(F.col("id")).alias("source"), F.concat(nested, F.coalesce("own", F.lit(""))).alias("body"))


def nested_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    return crawl.sitemap_tree(_maps(spark, d), spark.createDataFrame([("https://m/sitemap0",)], "url string"), START, FORBIDDEN)


def crawl_state(spark: SparkSession, d: str) -> DataFrame:
    """The queue after a round over the frontier, saved and loaded again."""
    path = new_folder(spark, "state")
    pages = _html(spark, d).where("url is not null").groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id"))
    _, queue = crawl.crawl_round(table(spark, d, "frontier").select("url", "status"), pages.select("page_id", "url", "html"), START, FORBIDDEN)
    crawl.save_state(queue, path, disallowed=FORBIDDEN)
    return crawl.load_state(spark, path)[0]


def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("User-agent: *\nDisallow: /a/"), F.col("entry_id"), F.lit("\nCrawl-delay: "), F.col("request_delay"), F.lit("\nSitemap: s.xml\nAllow:\n"))
    return crawl.robots_rules(table(spark, d, "frontier").select(F.col("entry_id").alias("source"), body.alias("body")))


def _glob(d: str, name: str) -> str:
    """A pattern for the table, be it a file or a folder; a stream takes a plain path for a folder only."""
    return f"{d.rstrip('/')}/{name}.parque[t]"


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as a stream, indexed batch by batch; df of each term from the postings written."""
    folder = new_folder(spark, "stream")
    still = table(spark, d, "documents")
    stream = spark.readStream.schema(still.schema).option("maxFilesPerTrigger", 64).parquet(_glob(d, "documents"))
    ingest.index_stream(index.unique_corpus(stream), f"{folder}/postings", f"{folder}/checkpoint", LANGUAGE).awaitTermination()
    return ingest.latest_postings(spark, f"{folder}/postings").groupBy("term").agg(F.count("*").alias("df"))


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Pages read as a stream, the first of each url; the watermark covers all times of the table, so that none comes out twice."""
    folder = new_folder(spark, "stream")
    still = table(spark, d, "crawled_pages")
    stream = spark.readStream.schema(still.schema).parquet(_glob(d, "crawled_pages"))
    fresh = ingest.first_seen(stream.where("url is not null"), "url", "ingested_at", "3650 days").select("url")
    fresh.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("url string").parquet(f"{folder}/out")


_NAMES = """bm25_search tfidf_search bm25_topk tfidf_topk candidates term_breakdown trec_run bm25_stemmed
tokenize_typed simple_tokenize split_tokenize whitespace_tokenize token_type_filter stopword_filter min_length_filter strip_diacritics terms_baseline stem_cs lemma_lookup preprocess
vocabulary postings term_stats doc_stats collection_stats index_rebuild index_build index_search index_meta preprocessed_search fingerprint
highlight kwic ranked_snippets metadata_enrich metadata_merge crawl_metadata snippet_texts results_display get_document eval_metrics eval_means
detect_text_keys normalize_docs evaluation_docs evaluation_queries preprocessed_texts dedupe_last size_text content_md5
html_title html_fields html_article html_records html_links link_filter frontier_antijoin sitemap_urls nested_sitemaps crawl_state robots_rules
bool_malformed bool_batch bool_queries bool_results stream_ingest stream_first_seen""".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES} | {name: _boolean(name) for name in BOOLEAN}
