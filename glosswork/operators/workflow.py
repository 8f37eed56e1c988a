"""Whole runs: preprocessing with its records of metadata, and ranked or Boolean retrieval over a collection file."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import analyze as A
from glosswork.functions.text import is_blank
from glosswork.operators import boolean, index, rank
from glosswork.operators.pipelines import Pipeline, chosen
from glosswork.session import exists, size_of, written
from glosswork.sources import records


def _plain(docs: DataFrame, key: str) -> DataFrame:
    """(term, doc_id, tf) by the tokenizer of small collections: words in lower case, nothing left out."""
    each = docs.select(F.col(key).alias("doc_id"), F.explode(A.plain_terms(F.col("text"))).alias("term"))
    return each.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))


@dataclass
class CollectionRun:
    """What a run over a collection gives; each field is computed when it is read."""

    name: str
    built: bool
    index: index.Index
    terms: DataFrame
    vectors: DataFrame
    query_vectors: DataFrame
    ranking: DataFrame


def run_collection(spark: SparkSession, path: str, index_path: str) -> CollectionRun:
    """Ranked retrieval for a collection file: its cached index, term statistics, vectors of documents and queries, and the ranking by cosine.

    The index at ``index_path`` is used if number and digest of the documents and the path of the collection are those it was saved with,
    else it is built and saved. terms (term, df, idf), vectors (doc_id, term, tf, wtf, tfidf, normalised), query_vectors (qid, ...), ranking
    (qid, doc_id, score, rank); a query without match has no row there.
    """
    collection = records.read_collection(spark, path)
    documents = index.corpus(collection.documents)
    built = not index.is_current(spark, index_path, documents, path)
    if built:
        index.build(documents, postings=written(_plain(documents, "doc_id"))).save(index_path, documents, source=path)
    made = index.load(spark, index_path)
    asked = _plain(collection.queries.where(~is_blank(F.col("text"))).select("qid", "text"), "qid").select(F.col("doc_id").alias("qid"), "term", F.col("tf").cast("bigint").alias("q_tf"))
    own = made.postings.select(F.col("doc_id").alias("qid"), "term", F.col("tf").cast("bigint").alias("q_tf"))
    vectors = rank.term_breakdown(made, own).withColumnRenamed("qid", "doc_id")
    terms = made.terms.select("term", "df", F.round("idf", 6).alias("idf"))
    ranked = rank.top_k(rank.cosine_scores(made, asked), 2**31 - 1)
    return CollectionRun(collection.name, built, made, terms, vectors, rank.term_breakdown(made, asked), ranked)


def run_boolean_collection(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score): Boolean retrieval for a collection file, by its own queries or by ``queries`` (qid, text)."""
    collection = records.read_collection(spark, path)
    documents = index.corpus(collection.documents)

    def normalise(operands: list[str]) -> list[list[str]]:
        rows = spark.createDataFrame(list(enumerate(operands)), "n int, text string").select("n", A.plain_terms(F.col("text")).alias("t")).collect() if operands else []
        return [r["t"] for r in sorted(rows, key=lambda r: r["n"])]

    return boolean.search_many(written(_plain(documents, "doc_id")), documents, collection.queries if queries is None else queries, normalise)


def preprocess(
    rows: DataFrame, ordinal: str, folder: str, pipelines: str = "all", language: str = "cs", text_keys: list[str] | None = None, source: str = "", lemmas: DataFrame | None = None, write_vocabulary: bool = True,
) -> dict:
    """Normalises records by each pipeline and writes below ``folder``: docs_<pipeline>_<language>, vocab_<...>, and a row of metadata in ``runs``.

    ``ordinal`` is a column that numbers the records from 1. Text is taken from ``text_keys``, else from the keys that are found. Where the vocabulary
    of the Czech baseline is written, a copy of it stands under ``vocab``. Returns the row of metadata.
    """
    spark, began, at = rows.sparkSession, time.perf_counter(), datetime.now(timezone.utc)
    detected = [r["key"] for r in records.detect_text_keys(rows).orderBy(F.desc("filled"), "key").collect()]
    keys = records.choose_text_keys(rows.columns, detected, text_keys)
    documents = written(records.normalise_documents(rows, keys, ordinal))
    names, artifacts = chosen(pipelines), []
    for name in names:
        pipe = Pipeline(name, language)
        options = pipe.options(lemmas)
        tokens = A.terms(F.col("text"), language, options["stem"])
        docs_path, vocab_path = f"{folder}/docs_{name}_{language}", f"{folder}/vocab_{name}_{language}"
        made = documents.withColumn("tokens", tokens)
        if options["lemmas"] is not None:
            made = _lemmatised(made, options["lemmas"])
        records.write_preprocessed(made.withColumn("normalized_text", F.array_join("tokens", " ")), docs_path)
        if write_vocabulary:
            counted = written(spark.read.schema("tokens array<string>").json(docs_path).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("freq")))
            for path in [vocab_path, *([f"{folder}/vocab"] if name == "baseline" and language == "cs" else [])]:
                records.write_vocabulary(counted, path)
        artifacts.append((name, docs_path, vocab_path if write_vocabulary else None))
    row = {"created_at_utc": at.isoformat(), "duration_seconds": round(time.perf_counter() - began, 3), "input_path": source, "output_dir": folder, "language": language, "text_keys": keys, "pipelines": names, "document_count": documents.count(), "output_bytes": size_of(spark, folder), "docs": [d for _, d, _ in artifacts], "vocabularies": [v for *_, v in artifacts if v]}
    kinds = "created_at_utc string, duration_seconds double, input_path string, output_dir string, language string, text_keys array<string>, pipelines array<string>, document_count bigint, output_bytes bigint, docs array<string>, vocabularies array<string>"
    spark.createDataFrame([tuple(row.values())], kinds).coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    return row


def _lemmatised(docs: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``docs`` with the lemmas of its tokens in their order; rows are told apart by a number of their own."""
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    words = lemmas.where(~F.col("form").rlike(r"^\p{Nd}"))
    each = A.lemmatise(numbered.select("_row", F.posexplode("tokens").alias("_at", "term")), words)
    joined = each.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "lemma"))), lambda x: x["lemma"]).alias("_lemmas"))
    return numbered.join(joined, "_row", "left").withColumn("tokens", F.coalesce("_lemmas", F.array().cast("array<string>"))).drop("_row", "_lemmas")


def preprocessing_context(spark: SparkSession, docs_path: str) -> dict | None:
    """Input, language and text keys of the latest run that wrote the preprocessed records at ``docs_path``; None if none did."""
    runs = f"{docs_path.rstrip('/').rpartition('/')[0]}/runs"
    if not exists(spark, runs):
        return None
    found = spark.read.parquet(runs).where(F.array_contains("docs", docs_path.rstrip("/"))).orderBy(F.desc("created_at_utc")).first()
    return {k: found[k] for k in ("input_path", "language", "text_keys")} if found else None


def index_preprocessed(spark: SparkSession, docs_path: str, index_path: str, pipeline: str = "baseline") -> dict[str, str]:
    """Indexes preprocessed records as they are, split at white space, and returns the metadata of the index. Raises without documents."""
    rows = spark.read.schema("id string, doc_id string, normalized_text string").json(docs_path)
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    documents = written(records.preprocessed_texts(numbered, "n"))
    each = documents.select("doc_id", F.explode(A.space_terms(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))
    if documents.isEmpty():
        raise ValueError(f"no documents with text in {docs_path}")
    return index.build(documents, postings=written(each)).save(index_path, documents, source=docs_path, pipeline=pipeline, input_size_bytes=str(size_of(spark, docs_path)))
