"""The inverted index as DataFrames: postings, terms, docs, stats; saved, opened again and checked."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions.analyze import lemmatise
from glosswork.functions.analyze import terms as analyse
from glosswork.functions.text import is_blank
from glosswork.session import exists, new_folder, size_of, stamp_of, written

FORMAT = "parquet-2"
#: The most frequent terms, whose idf is sent to the postings; the others are joined by term, where none is hot any more.
HOT_TERMS = 20_000
# The fields of an index in one JSON document.
JSON_FIELDS = {"postings": "map<string, map<string, int>>", "doc_freq": "map<string, int>", "idf": "map<string, double>", "doc_lengths": "map<string, int>", "avgdl": "double", "num_docs": "bigint"}


def corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): documents with text that is not blank, ids as strings.

    Where an id repeats, the row with the greatest text stands for it (rows of a table have no order
    in which one could be the last; see ``dedupe_last`` for tables with an ordinal).
    """
    return unique_corpus(docs, key, text).groupBy("doc_id").agg(F.max("text").alias("text"))


def unique_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``corpus`` for tables whose key is known to be unique: a filter without a shuffle."""
    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text")).where(~is_blank(F.col("text")) & F.col("doc_id").isNotNull())


def weight_tf(tf: Column) -> Column:
    """1 + log10(tf); 0 where tf is not positive."""
    return F.when(tf > 0, 1 + F.log10(tf)).otherwise(F.lit(0.0))


@dataclass
class Index:
    """postings(term, doc_id, tf, dl), terms(term, df, idf), docs(doc_id, dl, norm), stats(n, avgdl); the row of meta where it was saved.

    Postings hold the length of their document, so ranking does not join the documents.
    """

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame
    meta: dict[str, str] = field(default_factory=dict)

    def save(self, path: str, documents: DataFrame | None = None, **meta: str) -> dict[str, str]:
        """Writes the tables as Parquet, postings sorted by term within ranges of it, and one row of metadata, which is returned.

        Metadata: format, time, seconds, counts of documents and terms, bytes, what ``meta`` adds (pipeline, language, source),
        and the fingerprint of ``documents`` where they are given.
        """
        began, at = time.perf_counter(), datetime.now(timezone.utc).isoformat()
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("terms", "docs", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        row = {"format": FORMAT, "created_at_utc": at, **meta}
        if documents is not None:
            mark = fingerprint(documents).first()
            row |= {"documents": str(mark["documents"]), "fingerprint": mark["fingerprint"]}
        row |= {"doc_count": str(spark.read.parquet(f"{path}/docs").count()), "term_count": str(spark.read.parquet(f"{path}/terms").count())}
        row |= {"index_size_bytes": str(size_of(spark, path)), "duration_seconds": f"{time.perf_counter() - began:.3f}"}
        spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row)).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return row


def load(spark: SparkSession, path: str) -> Index:
    """A saved index; nothing is read before it is used, but for the row of metadata."""
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "docs", "stats")), meta(spark, path))


def meta(spark: SparkSession, path: str) -> dict[str, str]:
    """The row of metadata written with an index."""
    return spark.read.parquet(f"{path}/meta").first().asDict()


def is_current(spark: SparkSession, path: str, documents: DataFrame, source: str | None = None) -> bool:
    """True where an index is saved at ``path`` whose format, source (if asked for) and number and fingerprint of documents are these."""
    if not exists(spark, f"{path}/meta"):
        return False
    stored = meta(spark, path)
    row = fingerprint(documents).first()
    same = stored.get("format") == FORMAT and stored.get("documents") == str(row["documents"]) and stored.get("fingerprint") == row["fingerprint"]
    return same and (source is None or stored.get("source") == source)


def cached(path: str, documents: DataFrame, source: str, language: str = "cs", stem: bool = False, lemmas: DataFrame | None = None, **more: str) -> tuple[Index, bool]:
    """(index, built): the index saved at ``path`` if it is that of ``documents`` and ``source``, else a new one, which is saved there."""
    spark = documents.sparkSession
    if is_current(spark, path, documents, source):
        return load(spark, path), False
    build(documents, language, stem, lemmas=lemmas).save(path, documents, source=source, language=language, **more)
    return load(spark, path), True


_SHARED: dict[tuple, str] = {}


def shared(documents: DataFrame, language: str = "cs", stem: bool = False) -> Index:
    """The index of ``documents``, built once per session and state of the files that they are read from."""
    spark = documents.sparkSession
    key = (spark.sparkContext.applicationId, stamp_of(documents), language, stem)
    if key not in _SHARED or not exists(spark, f"{_SHARED[key]}/meta"):
        path = new_folder(spark, "index")
        build(documents, language, stem).save(path, language=language)
        _SHARED[key] = path
    return load(spark, _SHARED[key])


def read_json(spark: SparkSession, path: str) -> Index:
    """An index from one JSON document, bare or as the field ``index`` beside ``meta``.

    What the document lacks is made from its postings. One such file is one task: the format is for exchange, not for size.
    """
    whole = spark.read.text(path, wholetext=True)
    inner, outer = (", ".join(f"{k}{sign} {kind}" for k, kind in JSON_FIELDS.items()) for sign in (":", ""))
    parsed = whole.select(F.from_json("value", f"meta map<string, string>, index struct<{inner}>, {outer}").alias("w"))
    bare = F.struct(*(F.col(f"w.{k}") for k in JSON_FIELDS))
    one = written(parsed.select(F.col("w.meta").alias("meta"), F.coalesce("w.index", bare).alias("i")).select("meta", "i.*"))
    postings = one.select(F.explode("postings").alias("term", "held")).select("term", F.explode("held").alias("doc_id", "tf")).where("term is not null and doc_id is not null")
    found = one.first()
    lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    if found["doc_lengths"]:
        lengths = one.select(F.explode("doc_lengths").alias("doc_id", "dl")).select("doc_id", F.col("dl").cast("bigint").alias("dl"))
    made = _tables(postings.join(lengths, "doc_id", "left").select("term", "doc_id", "tf", "dl"), lengths, found["num_docs"], found["avgdl"])
    if found["idf"]:
        told = one.select(F.explode("idf").alias("term", "idf"))
        df = made.terms.select("term", "df") if not found["doc_freq"] else one.select(F.explode("doc_freq").alias("term", "df")).select("term", F.col("df").cast("bigint").alias("df"))
        made.terms = df.join(told, "term", "left").select("term", "df", F.coalesce("idf", F.lit(0.0)).alias("idf"))
        made.docs = _docs(made.postings, made.terms, lengths)
    return Index(made.postings, made.terms, made.docs, made.stats, dict(found["meta"] or {}))


def _analysed(documents: DataFrame, language: str, stem: bool, lemmas: DataFrame | None) -> DataFrame:
    """(doc_id, dl, term, tf): how often each term occurs in each document, and its length; a document without terms has one row without term."""
    found = documents.select("doc_id", analyse(F.col("text"), language, stem).alias("all")).select("doc_id", F.size("all").cast("bigint").alias("dl"), F.explode_outer("all").alias("term"))
    counted = found.groupBy("doc_id", "dl", "term").agg(F.count("term").cast("int").alias("tf"))
    if lemmas is not None:
        words = lemmas.where(~F.col("form").rlike(r"^\p{Nd}"))
        counted = lemmatise(counted, words).groupBy("doc_id", "dl", F.col("lemma").alias("term")).agg(F.sum("tf").cast("int").alias("tf"))
    return counted.select("doc_id", "dl", "term", "tf")


def postings_of(documents: DataFrame, language: str = "cs", stem: bool = False, lemmas: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf): how often each term occurs in each document.

    With ``lemmas`` (form, lemma), words are replaced by their lemma after they are counted, so
    the dictionary meets each form of a document once; numbers and dates keep their form.
    """
    return _analysed(documents, language, stem, lemmas).where("term is not null").select("term", "doc_id", "tf")


def term_table(postings: DataFrame, stats: DataFrame) -> DataFrame:
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", F.log10(F.col("n") / F.col("df")).alias("idf"))


def _docs(postings: DataFrame, table: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, dl, norm). The idf of the ``HOT_TERMS`` most frequent terms is broadcast, so their postings do not move to it."""
    hot = table.orderBy(F.desc("df"), "term").limit(HOT_TERMS).select("term", F.col("idf").alias("hot"))
    told = postings.join(F.broadcast(hot), "term", "left")
    rest = told.where("hot is null").join(table.select("term", "idf"), "term").select("doc_id", "tf", "idf")
    both = told.where("hot is not null").select("doc_id", "tf", F.col("hot").alias("idf")).unionByName(rest)
    square = both.groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(weight_tf(F.col("tf")) * F.col("idf"), 2))).alias("norm"))
    return lengths.join(square, "doc_id", "left").select("doc_id", "dl", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def _tables(postings: DataFrame, lengths: DataFrame, n: int | None = None, avgdl: float | None = None) -> Index:
    stats = lengths.agg((F.count("*") if n is None else F.lit(n).cast("bigint")).alias("n"), (F.coalesce(F.avg("dl"), F.lit(0.0)) if avgdl is None else F.lit(float(avgdl))).alias("avgdl"))
    table = term_table(postings, stats)
    return Index(postings, table, _docs(postings, table, lengths), stats)


def build(documents: DataFrame, language: str = "cs", stem: bool = False, drop_empty: bool = False, postings: DataFrame | None = None, lemmas: DataFrame | None = None) -> Index:
    """The index of (doc_id, text).

    n counts every document of ``documents``, those without any term included (they have dl 0); with
    ``drop_empty`` only documents with a term. The texts are analysed once: the postings and lengths are written to the shared folder, and all
    other tables are made from them. ``postings`` (term, doc_id, tf) may be given where they are
    stored already, e.g. to rebuild the derived tables.
    """
    if postings is None:
        rows = written(_analysed(documents, language, stem, lemmas))
        lengths = rows.groupBy("doc_id").agg(F.max("dl").alias("dl"))
        return _tables(rows.where("term is not null").select("term", "doc_id", "tf", "dl"), lengths.where("dl > 0") if drop_empty else lengths)
    postings = postings.select("term", "doc_id", "tf")
    held = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    lengths = held if drop_empty else documents.select("doc_id").join(held, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
    return _tables(postings.join(held, "doc_id").select("term", "doc_id", "tf", "dl"), lengths)


def rebuild(postings: DataFrame) -> Index:
    """The derived tables from postings alone; documents without terms are not known to them."""
    return build(postings.select("doc_id").distinct(), drop_empty=True, postings=postings)


def vocabulary(documents: DataFrame, language: str = "cs", stem: bool = False) -> DataFrame:
    """(term, freq) over all documents."""
    return documents.select(F.explode(analyse(F.col("text"), language, stem)).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def fingerprint(documents: DataFrame) -> DataFrame:
    """(documents, fingerprint): a count and a digest of (doc_id, text) that does not depend on order.

    The digests of the rows are summed in four columns of 32 bits, so no task sees more than its rows.
    """
    digest = F.sha2(F.concat(F.col("doc_id"), F.lit("\u0001"), F.col("text")), 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint")).alias(f"s{k}")
    sums = documents.agg(F.count("*").alias("documents"), *(part(k) for k in range(4)))
    return sums.select("documents", F.concat_ws("-", *(F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("string") for k in range(4))).alias("fingerprint"))


def dedupe_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each ``key``; of equal ones any. A null order comes below all others;
    null keys are one key.

    A maximum over whole rows, aggregated before the shuffle, so a hot key costs no more than others.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(order)).alias("_row")).select("_row.*")
