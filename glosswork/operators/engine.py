"""An index with its documents behind a few methods, and the evaluation of a batch of queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators import boolean, evaluate, index, rank, snippet
from glosswork.operators.pipelines import Pipeline, named
from glosswork.session import exists


class SearchEngine:
    """Documents (doc_id, text) indexed by a pipeline; ``lemmas`` (form, lemma) for those that take a dictionary.

    With ``made`` an index that is there is searched; ``documents`` may then be left out, which leaves no texts to show, and the
    documents that have a term are the universe of Boolean queries.
    """

    def __init__(self, documents: DataFrame | None, pipeline: Pipeline = Pipeline(), lemmas: DataFrame | None = None, made: index.Index | None = None) -> None:
        self.pipeline, self.options = pipeline, pipeline.options(lemmas)
        self.index = made or index.build(documents, **self.options)
        self.documents = documents
        self.spark = self.index.postings.sparkSession

    @classmethod
    def open(cls, spark: SparkSession, path: str, documents: DataFrame | None = None, pipeline: str | None = None, lemmas: DataFrame | None = None) -> SearchEngine:
        """Searches the index saved at ``path``, or in the JSON file there; its own metadata name the pipeline, else ``pipeline`` does."""
        made = index.read_json(spark, path) if path.endswith(".json") else index.load(spark, path)
        return cls(documents, named(made.meta.get("pipeline") or pipeline or "baseline"), lemmas, made)

    def save(self, path: str, source: str = "") -> dict[str, str]:
        """Saves the index with its metadata, from which ``open`` knows the pipeline."""
        return self.index.save(path, self.documents, pipeline=f"{self.pipeline.name}_{self.pipeline.language}", language=self.pipeline.language, source=source)

    @property
    def universe(self) -> DataFrame:
        return self.index.docs.where("dl > 0").select("doc_id") if self.documents is None else self.documents.select("doc_id")

    def get_document(self, doc_id: str) -> str:
        """The text of a document; empty if there is none."""
        row = self.documents.where(F.col("doc_id") == doc_id).select("text").first() if self.documents is not None else None
        return row["text"] or "" if row else ""

    def search_all(self, queries: DataFrame, k: int = 1000, scorer: str = "bm25") -> DataFrame:
        """(qid, doc_id, score, rank) of (qid, text); ``bm25``, else cosine."""
        asked = rank.query_terms(queries, **self.options)
        scores = rank.bm25_scores if scorer == "bm25" else rank.cosine_scores
        return rank.top_k(scores(self.index, asked), max(1, k))

    def search(self, query: str, k: int = 10, scorer: str = "bm25") -> DataFrame:
        one = self.spark.createDataFrame([("q", query)], "qid string, text string")
        return self.search_all(one, k, scorer).select("doc_id", "score", "rank")

    def _analyser(self):
        return boolean.analyser(self.spark, self.pipeline.language, self.pipeline.cuts_suffixes)

    def boolean_search(self, query: str) -> DataFrame:
        """(doc_id, score) in the order of doc_id; nothing for a query with a mistake."""
        return boolean.search(self.index.postings, self.universe, boolean.parse(query, self._analyser())).orderBy("doc_id")

    def boolean_search_all(self, queries: DataFrame | list[tuple[str, str]]) -> DataFrame:
        """(qid, doc_id, score) of a batch (qid, text)."""
        return boolean.search_many(self.index.postings, self.universe, queries, self._analyser())

    def explain_boolean(self, query: str) -> boolean.Parsed:
        """How a Boolean query was read, and how many documents meet it."""
        parsed = boolean.parse(query, self._analyser())
        parsed.hits = 0 if parsed.error else boolean.search(self.index.postings, self.universe, parsed).count()
        return parsed

    def boolean_counts(self, queries: DataFrame | list[tuple[str, str]]) -> DataFrame:
        """(qid, hits) of a batch (qid, text)."""
        return boolean.hit_counts(self.index.postings, self.universe, queries, self._analyser())

    def snippets(self, query: str, best: int = 3) -> DataFrame:
        """(doc_id, score, rank, snippet) of the best documents."""
        terms = self._analyser()([query])[0]
        texts = self.documents if self.documents is not None else self.universe.select("doc_id", F.lit(None).cast("string").alias("text"))
        return snippet.with_snippets(self.search(query, best), texts, snippet.query_terms_of(query, terms))


def run_benchmark(documents: DataFrame, queries: DataFrame, qrels: DataFrame, pipeline: Pipeline = Pipeline(), scorer: str = "bm25", k: int = 1000, lemmas: DataFrame | None = None) -> dict:
    """Quality and seconds of one configuration: index, ranked batch, metrics."""
    began = time.perf_counter()
    engine = SearchEngine(documents, pipeline, lemmas)
    size = engine.index.postings.count()
    indexed = time.perf_counter()
    run = engine.search_all(queries, k, scorer)
    run = run.persist()
    rows = run.count()
    ranked = time.perf_counter()
    quality = evaluate.means(evaluate.query_metrics(run, qrels)).first().asDict()
    run.unpersist()
    return {"pipeline": pipeline.name, "language": pipeline.language, "scorer": scorer, "postings": size, "rows": rows, "indexing": indexed - began, "ranked": ranked - indexed, **quality}


def benchmark_report(results: list[dict]) -> str:
    """Two tables in Markdown: quality and speed of each configuration."""
    number = lambda x: "-" if x is None else f"{x:.4f}"
    lines = ["| language | pipeline | scorer | MAP | P@10 | NDCG | MRR |", "|-|-|-|-|-|-|-|"]
    lines += [f"| {r['language']} | {r['pipeline']} | {r['scorer']} | " + " | ".join(number(r[c]) for c in ("map", "p_at_k", "ndcg", "mrr")) + " |" for r in results]
    lines += ["", "| language | pipeline | scorer | indexing s | ranked s |", "|-|-|-|-|-|"]
    lines += [f"| {r['language']} | {r['pipeline']} | {r['scorer']} | {r['indexing']:.1f} | {r['ranked']:.1f} |" for r in results]
    return "\n".join(lines) + "\n"


def evaluation(
    documents: DataFrame, queries: DataFrame, folder: str, qrels: DataFrame | None = None, boolean_queries: DataFrame | None = None,
    pipeline: Pipeline = Pipeline(), scorer: str = "tfidf", k: int = 1000, run_id: str = "run", lemmas: DataFrame | None = None, **about: str,
) -> dict:
    """Ranks a batch, writes the run file below ``folder``, and sums up: seconds and whether they meet the goals, quality, Boolean hits, files.

    The summary is a dictionary of plain values, for ``records.write_summary``. ``boolean_queries`` (qid, text) are counted
    where they are given; quality is there where ``qrels`` (qid, doc_id, rel) are.
    """
    began = time.perf_counter()
    engine = SearchEngine(documents, pipeline, lemmas)
    engine.index.postings.count()
    indexed = time.perf_counter()
    run = engine.search_all(queries, k, scorer).persist()
    rank.trec_lines(run, run_id).select(F.col("line").alias("value")).write.mode("overwrite").text(f"{folder}/run")
    ranked = time.perf_counter()
    hits = None
    if boolean_queries is not None:
        hits = {r["qid"]: r["hits"] for r in engine.boolean_counts(boolean_queries).collect()}
    counted = time.perf_counter()
    quality = evaluate.means(evaluate.query_metrics(run, qrels)).first().asDict() if qrels is not None else None
    run.unpersist()
    spark = documents.sparkSession
    seconds = {"indexing": round(indexed - began, 3), "ranked": round(ranked - indexed, 3)}
    goals = evaluate.against_goals(spark.createDataFrame(list(seconds.items()), "stage string, seconds double"))
    return {
        "meta": {"pipeline": pipeline.name, "language": pipeline.language, "scorer": scorer, "run_id": run_id, "query_count": queries.count(), "document_count": engine.index.stats.first()["n"], **about},
        "timing_seconds": {**seconds, "boolean": round(counted - ranked, 3) if hits is not None else None},
        "thresholds": {r["stage"]: r["met"] for r in goals.collect()},
        "artifacts": {"run": f"{folder}/run"},
        "quality": quality,
        "boolean": {"enabled": hits is not None, "hit_counts": hits},
    }


def open_or_build(spark: SparkSession, path: str, documents: DataFrame, source: str, pipeline: Pipeline = Pipeline(), lemmas: DataFrame | None = None) -> tuple[SearchEngine, bool]:
    """(engine, built): the index at ``path`` where it is that of these documents, pipeline and source, else a new one, saved there."""
    name = f"{pipeline.name}_{pipeline.language}"
    if exists(spark, f"{path}/meta") and index.meta(spark, path).get("pipeline") == name and index.is_current(spark, path, documents, source):
        return SearchEngine.open(spark, path, documents, lemmas=lemmas), False
    SearchEngine(documents, pipeline, lemmas).save(path, source)
    return SearchEngine.open(spark, path, documents, lemmas=lemmas), True
