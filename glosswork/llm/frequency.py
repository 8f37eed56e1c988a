"""Problem 1: occurrences and records of every distinct term, by sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.latest import latest_in_place

_RUN = "pipeline string, term string, occurrences bigint, records bigint"


def _differs(column: pa.Array) -> np.ndarray:
    """True where a value is not the one before it; two nulls are the same. The first is always different."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] = ~same.to_numpy(zero_copy_only=False).astype(bool)
    return out


def _piece(pipeline: pa.Array, term: pa.Array, occurrences: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pipeline, term, pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], names=["pipeline", "term", "occurrences", "records"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted (pipeline, term, doc_id): one row per run of a term, with its length and the number of its records.

    A run that goes on in the next batch is carried over with its last record, so a batch border
    costs nothing; a run cut by a partition border comes out in two rows.
    """
    held: tuple | None = None  # pipeline, term, occurrences, records, last record
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        pipeline, term, doc = (batch.column(c) for c in ("pipeline", "term", "doc_id"))
        new = _differs(pipeline) | _differs(term)
        starts = np.flatnonzero(new)
        occurrences = np.diff(np.append(starts, size))
        records = np.add.reduceat((new | _differs(doc)).astype(np.int64), starts)
        at = pa.array(starts)
        names = [pipeline.take(at), term.take(at)]
        if held is not None:
            if held[:2] == (names[0][0].as_py(), names[1][0].as_py()):
                occurrences[0] += held[2]
                records[0] += held[3] - (doc[0].as_py() == held[4])
            else:
                yield _piece(pa.array([held[0]], pa.string()), pa.array([held[1]], pa.string()), np.array([held[2]]), np.array([held[3]]))
        held = (names[0][-1].as_py(), names[1][-1].as_py(), int(occurrences[-1]), int(records[-1]), doc[size - 1].as_py())
        k = len(starts) - 1
        if k:
            yield _piece(names[0].slice(0, k), names[1].slice(0, k), occurrences[:-1], records[:-1])
    if held is not None:
        yield _piece(pa.array([held[0]], pa.string()), pa.array([held[1]], pa.string()), np.array([held[2]]), np.array([held[3]]))


def term_counts(docs: DataFrame) -> DataFrame:
    """(pipeline, term, occurrences, records) over the rows of preprocessed_docs that count.

    The pairs of term and record, one for every occurrence, are
    sorted by ranges of (pipeline, term, record), and a scan of the sorted runs
    counts occurrences and distinct records. As the record is part of the range key, a
    term that fills a third of all pairs is cut over several tasks; the rows of
    its pieces are then added up. All occurrences in one record have the same key, so none is counted as two records.

    Null and empty tokens are no terms; tokens are compared as stored, so case
    and inner spaces matter. A null token array counts as an empty one. Null
    pipelines form a group of their own, null doc_ids one record. An empty table gives no rows.
    """
    pairs = latest_in_place(docs, "tokens").select("pipeline", "doc_id", F.explode("tokens").alias("term")).where("term <> ''")
    keys = ["pipeline", "term", "doc_id"]
    ordered = pairs.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_runs, _RUN).groupBy("pipeline", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def record_counts(docs: DataFrame) -> DataFrame:
    """(pipeline, total): the number of counting records with at least one term."""
    some = F.exists("tokens", lambda t: t != "")
    return latest_in_place(docs, "tokens").where(some).groupBy("pipeline").agg(F.count("*").alias("total"))


def marked_terms(docs: DataFrame, common_share: float = 0.2) -> DataFrame:
    """``term_counts`` with total and mark: ``rare`` (in one record only), ``common`` (in more
    than ``common_share`` of the records that have a term), else null.

    A term that is both (a single record in a tiny pipeline) is ``common`` only if it
    occurs in several records; one record always means ``rare``.
    """
    totals = record_counts(docs).withColumnRenamed("pipeline", "p")
    counts = term_counts(docs)
    joined = counts.join(F.broadcast(totals), counts.pipeline.eqNullSafe(totals.p)).drop("p")
    mark = F.when(F.col("records") == 1, F.lit("rare")).when(F.col("records") > F.col("total") * F.lit(common_share), F.lit("common"))
    return joined.withColumn("mark", mark)


def refreshed_vocab(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(pipeline, term, stored, counted): each distinct vocabulary entry beside its true count.

    ``stored`` is the greatest freq of doubled entries, null if none has one; ``counted``
    is 0 for a term that no longer occurs.
    """
    listed = vocab.where(F.col("term").isNotNull()).groupBy("pipeline", "term").agg(F.max("freq").alias("stored"))
    return listed.join(term_counts(docs).select("pipeline", "term", "occurrences"), ["pipeline", "term"], "left").select("pipeline", "term", "stored", F.coalesce("occurrences", F.lit(0)).cast("bigint").alias("counted"))
