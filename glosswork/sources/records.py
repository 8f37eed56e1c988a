"""Records from JSON, JSON lines, Parquet and collection files; choice of keys; writers."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions.text import is_blank
from glosswork.resources import DOCUMENT_ID_KEYS, QUERY_ID_KEYS, QUERY_TEXT_KEYS, TEXT_KEYS, TITLE_KEYS
from glosswork.session import exists

_ID_LIKE = ("id", "ids", "doc_id", "document_id", "docno", "url")


def read_records(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """The records of a JSON or JSON-lines file or folder.

    ``.jsonl`` is read by line. Of other files the first line tells: they are read by line if it is a whole record, else
    whole (a list of records or one record). A malformed record raises unless
    ``lenient``, which leaves it out. A missing path raises, unless ``lenient``, which then gives no rows and no columns.
    """
    if lenient and not exists(spark, path):
        return spark.createDataFrame([], "")
    reader = spark.read.option("mode", "DROPMALFORMED" if lenient else "FAILFAST")
    if not path.endswith((".jsonl", ".ndjson")) and not _by_line(spark, path):
        reader = reader.option("multiLine", True)
    return reader.json(path)


def _by_line(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(~is_blank(F.col("value"))).first()
    line = first["value"].strip() if first else ""
    if line[:1] != "{":
        return line[:1] != "["
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def text_of(row_keys: list[str], columns: list[str]) -> Column:
    """The first of the keys whose value is not blank, stripped."""
    there = [k for k in row_keys if k in columns]
    stripped = [F.regexp_replace(F.col(f"`{k}`").cast("string"), r"^(?U)\s+|(?U)\s+$", "") for k in there]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in stripped)) if there else F.lit(None).cast("string")


def detect_text_keys(rows: DataFrame, sample: int = 200) -> DataFrame:
    """(key, filled): string columns by the number of values that are not blank in ``sample`` rows, most first; none at 0.

    The sample is what the operator is: keys are chosen by a look at the first rows.
    """
    keys = [c for c, t in rows.dtypes if t == "string"]
    if not keys:
        return rows.sparkSession.createDataFrame([], "key string, filled bigint")
    head = rows.select(*(f"`{k}`" for k in keys)).limit(sample)
    counts = head.agg(*(F.count_if(~is_blank(F.col(f"`{k}`"))).alias(f"c{n}") for n, k in enumerate(keys)))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"c{n}").alias("filled")) for n, k in enumerate(keys))))
    return counts.select(pairs.alias("p")).select("p.key", "p.filled").where("filled > 0")


def choose_text_keys(columns: list[str], detected: list[str], wanted: list[str] | None = None) -> list[str]:
    """The keys to take text from: those asked for (unknown ones raise), else article_text, text, or the best found."""
    if wanted:
        unknown = [k for k in wanted if k not in columns]
        if unknown:
            raise ValueError(f"no such keys: {', '.join(unknown)}")
        return list(dict.fromkeys(wanted))
    for key in ("article_text", "text"):
        if key in detected:
            return [key]
    best = [k for k in detected if k not in _ID_LIKE]
    return best[:1]


def joined_text(keys: list[str]) -> Column:
    """The values of ``keys``, stripped, joined by an empty line; ids and blanks are left out; null if nothing is left."""
    parts = [F.nullif(F.regexp_replace(F.col(f"`{k}`").cast("string"), r"^(?U)\s+|(?U)\s+$", ""), F.lit("")) for k in keys if k not in _ID_LIKE]
    return F.nullif(F.concat_ws("\n\n", *parts), F.lit("")) if parts else F.lit(None).cast("string")


def record_id(columns: list[str], ordinal: Column) -> Column:
    """doc_id, id or url, whichever first is neither null, empty nor the number 0; else doc_ and the ordinal."""
    there = [F.col(f"`{k}`") for k in ("doc_id", "id", "url") if k in columns]
    used = [F.when((c.cast("string") != "") & (c.cast("string") != "0"), c.cast("string")) for c in there]
    return F.coalesce(*used, F.concat(F.lit("doc_"), ordinal.cast("string")))


def normalise_documents(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """(id, doc_id, url, text): records with text, by the chosen keys; ``ordinal`` numbers the rows from 1."""
    name = record_id(rows.columns, F.col(ordinal))
    url = F.col("url").cast("string") if "url" in rows.columns else F.lit(None).cast("string")
    return rows.select(name.alias("id"), name.alias("doc_id"), url.alias("url"), joined_text(keys).alias("text")).where("text is not null")


def evaluation_documents(rows: DataFrame, ordinal: str) -> DataFrame:
    """(doc_id, text): the first usable id and text of each record, by the fixed lists of keys; d and the ordinal without id."""
    name = F.coalesce(text_of(DOCUMENT_ID_KEYS, rows.columns), F.concat(F.lit("d"), F.col(ordinal).cast("string")))
    return rows.select(name.alias("doc_id"), text_of(TEXT_KEYS, rows.columns).alias("text")).where("text is not null")


def evaluation_queries(rows: DataFrame, ordinal: str) -> DataFrame:
    """(qid, text): the same for queries; q and the ordinal without id."""
    name = F.coalesce(text_of(QUERY_ID_KEYS, rows.columns), F.concat(F.lit("q"), F.col(ordinal).cast("string")))
    return rows.select(name.alias("qid"), text_of(QUERY_TEXT_KEYS, rows.columns).alias("text")).where("text is not null")


def metadata(rows: DataFrame, ordinal: str) -> DataFrame:
    """(key, title, url): a title for each record under its id and under its url; ``Unknown`` without title.

    Of several records under one key, the one with the greatest ordinal counts.
    """
    name = F.trim(record_id(rows.columns, F.col(ordinal)))
    url = F.nullif(F.trim(F.col("url").cast("string")), F.lit("")) if "url" in rows.columns else F.lit(None).cast("string")
    base = rows.select(F.col(ordinal).alias("_n"), name.alias("doc_id"), url.alias("url"), F.coalesce(text_of(TITLE_KEYS, rows.columns), F.lit("Unknown")).alias("title"))
    keyed = base.select("_n", F.explode(F.array_distinct(F.array_compact(F.array("doc_id", "url")))).alias("key"), "title", "url").where("key <> ''")
    return keyed.groupBy("key").agg(F.max_by(F.struct("title", "url"), "_n").alias("m")).select("key", "m.title", "m.url")


def crawl_metadata(rows: DataFrame, ordinal: str) -> DataFrame:
    """(key, title, author, text) of crawled records under their url; ``No title`` and an empty author where there is none, text only where it is not blank.

    Of several records of a url the one with the greatest ordinal counts; records without url are left out.
    """
    text = F.when(~is_blank(F.col("article_text")), F.col("article_text"))
    kept = rows.where("url <> ''").select(F.col(ordinal).alias("_n"), F.col("url").alias("key"), F.coalesce("title", F.lit("No title")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), text.alias("text"))
    return kept.groupBy("key").agg(F.max_by(F.struct("title", "author", "text"), "_n").alias("m")).select("key", "m.title", "m.author", "m.text")


def merged_metadata(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, title, url) of both; where both know a key the first wins."""
    a = first.select("key", F.col("title").alias("t1"), F.col("url").alias("u1"), F.lit(True).alias("there"))
    b = second.select("key", F.col("title").alias("t2"), F.col("url").alias("u2"))
    return a.join(b, "key", "full").select("key", F.when(F.col("there"), F.col("t1")).otherwise(F.col("t2")).alias("title"), F.when(F.col("there"), F.col("u1")).otherwise(F.col("u2")).alias("url"))


def preprocessed_texts(rows: DataFrame, ordinal: str) -> DataFrame:
    """(doc_id, text) of preprocessed records: blank ones dropped, of repeated ids the last; doc_ and the ordinal without id."""
    name = F.coalesce(F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.concat(F.lit("doc_"), F.col(ordinal).cast("string")))
    kept = rows.select(F.col(ordinal).alias("_n"), name.alias("doc_id"), F.col("normalized_text").alias("text")).where(~is_blank(F.col("text")))
    return kept.groupBy("doc_id").agg(F.max_by("text", "_n").alias("text"))


def snippet_texts(columns: list[str]) -> Column:
    """The raw text of a preprocessed record where it has one, else its normalised text."""
    return text_of([k for k in ("text", "normalized_text") if k in columns], columns)


@dataclass
class Collection:
    name: str
    documents: DataFrame
    queries: DataFrame


def read_collection(spark: SparkSession, path: str) -> Collection:
    """Documents and queries from a text file of ``d...: text`` and ``q...: text`` lines.

    Names are told by their first letter, whatever its case, and end at the first colon. Blank lines are
    skipped; any other line raises when it is read.
    """
    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    name = F.trim(F.regexp_extract("value", r"^\s*([^:]*):", 1))
    kind = F.lower(F.substring(name, 1, 1))
    good = kind.isin("d", "q") & F.col("value").contains(":")
    rows = lines.select(F.when(good, kind).otherwise(F.raise_error(F.concat(F.lit("not a collection line: "), F.col("value")))).alias("kind"), name.alias("name"), F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1)).alias("text"))
    return Collection(Path(path).stem, rows.where("kind = 'd'").select(F.col("name").alias("doc_id"), "text"), rows.where("kind = 'q'").select(F.col("name").alias("qid"), "text"))


def looks_like_collection(path: str, lines: int = 30) -> bool:
    """True where one of the first lines of a small text file begins like a document or query."""
    if Path(path).name.lower().startswith("vocab"):
        return False
    with open(path, encoding="utf-8", errors="replace") as f:
        head = [x.strip() for _, x in zip(range(lines), (y for y in f if y.strip()), strict=False)]
    return any(x[:1].lower() in "dq" and ":" in x for x in head if x)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text): one query per line that is not blank, named q and the number of the line."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return rows.where(~is_blank(F.col("line"))).select(F.concat(F.lit("q"), (F.col("n") + 1).cast("string")).alias("qid"), F.trim("line").alias("text"))


def boolean_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text): as ``read_queries``, named bq and the number of the line."""
    return read_queries(spark, path).select(F.concat(F.lit("b"), "qid").alias("qid"), "text")


def query_command(spark: SparkSession, text: str) -> DataFrame | None:
    """The queries of the file that a query ``file:<path>`` names; None for any other query. Raises without a path."""
    if not text.lower().startswith("file:"):
        return None
    path = text[len("file:") :].strip()
    if not path:
        raise ValueError("give a path: file:<path>")
    return read_queries(spark, path)


def discover(spark: SparkSession, folder: str, pattern: str = "*.{json,jsonl}", recursive: bool = False) -> list[str]:
    """The paths below ``folder`` whose name has the form ``pattern``, in order; none where the folder is missing.

    Such as ``docs_*`` for preprocessed records and ``inverted_index_*.json`` for indexes; with ``recursive`` at any depth.
    """
    if not exists(spark, folder):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found, open_ = [], [folder.rstrip("/")]
    while open_:
        at = open_.pop()
        found += [x.getPath().toString() for x in files.globStatus(hadoop.Path(f"{at}/{pattern}")) or []]
        if recursive:
            open_ += [x.getPath().toString() for x in files.listStatus(hadoop.Path(at)) if x.isDirectory()]
    return sorted(x.removeprefix("file:") for x in found)


def write_preprocessed(docs: DataFrame, path: str) -> None:
    """Preprocessed records as JSON lines: id, doc_id, url, tokens, normalized_text."""
    docs.select("id", "doc_id", "url", "tokens", "normalized_text").write.mode("overwrite").json(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """``term freq`` lines, most frequent first, equal ones by term."""
    vocabulary.orderBy(F.desc("freq"), "term").select(F.concat_ws(" ", "term", "freq").alias("value")).write.mode("overwrite").text(path)


def write_run(lines: DataFrame, path: str) -> None:
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_summary(path: str, **parts: object) -> None:
    """A small summary as JSON, from driver values."""
    Path(path).write_text(json.dumps(parts, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
