"""Term counts and term scores against plain Python."""

import math
from collections import Counter, defaultdict

import pytest

from glosswork.llm import distinctive, frequency

_DOCS = "row_id bigint, pipeline string, doc_id string, tokens array<string>, normalized_text string, term string, df int"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], _DOCS)


ROWS = [
    (1, "baseline", "a", ["x", "x", "", None, "y"], "x x  y"),
    (2, "baseline", "b", ["x", "Z"], "x Z"),
    (5, "baseline", "c", ["x"], " \xa0"),
    (4, "baseline", "c", ["old"], "old text"),
    (6, "baseline", "d", None, None),
    (7, "baseline", "e", [], "y w\tw"),
    (8, "stemming", "a", ["x"], "x"),
    (9, None, "a", ["n"], "n"),
    (10, "baseline", None, ["q"], "q x"),
    (11, "baseline", "f", ["y", "y"], "x y y"),
]


def _counts(rows):
    last = {}
    for r in rows:
        if (r[1], r[2]) not in last or last[r[1], r[2]][0] < r[0]:
            last[r[1], r[2]] = r
    n, records, total = Counter(), Counter(), Counter()
    for r in last.values():
        terms = [t for t in r[3] or [] if t]
        total[r[1]] += bool(terms)
        for t, k in Counter(terms).items():
            n[r[1], t] += k
            records[r[1], t] += 1
    return last, n, records, total


def test_counts_and_marks(spark):
    _, n, records, total = _counts(ROWS)
    got = {(r["pipeline"], r["term"]): r for r in frequency.marked_terms(_rows(spark, ROWS)).collect()}
    assert {k: (r["occurrences"], r["records"], r["total"]) for k, r in got.items()} == {k: (n[k], records[k], total[k[0]]) for k in n}
    assert got["baseline", "x"]["mark"] == "common" and got["baseline", "Z"]["mark"] == "rare" and got[None, "n"]["mark"] == "rare"


def test_hot_term_over_many_tasks(spark):
    rows = [(k, "baseline", str(k), ["hot"] * (k % 3 + 1) + [f"t{k % 50}"], "x") for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in frequency.term_counts(_rows(spark, rows).repartition(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    _, n, records, _ = _counts(rows)
    assert got == {t: (n["baseline", t], records["baseline", t]) for _, t in n}


def test_empty_tables(spark):
    empty = _rows(spark, [])
    assert frequency.marked_terms(empty).count() == 0
    assert distinctive.top_terms(distinctive.term_scores(empty)).count() == 0


def test_vocabulary(spark):
    vocab = spark.createDataFrame([("baseline", "x", 9), ("baseline", "x", None), ("baseline", "gone", 1), ("baseline", None, 2)], "pipeline string, term string, freq bigint")
    got = {r["term"]: (r["stored"], r["counted"]) for r in frequency.refreshed_vocab(_rows(spark, ROWS), vocab).collect()}
    assert got == {"x": (9, 4), "gone": (1, 0)}


def _scores(rows):
    last, *_ = _counts(rows)
    docs = {k[1]: r[4].split() for k, r in last.items() if k[0] == "baseline" and r[4] and r[4].split()}
    df, cf = Counter(), Counter()
    for t in docs.values():
        df.update(set(t))
        cf.update(t)
    total, out = sum(cf.values()), {}
    for d, t in docs.items():
        for w, tf in Counter(t).items():
            cells = [tf, cf[w] - tf, len(t) - tf, total - len(t) - cf[w] + tf]
            expected = [len(t) * cf[w] / total, (total - len(t)) * cf[w] / total, len(t) * (total - cf[w]) / total, (total - len(t)) * (total - cf[w]) / total]
            g = 2 * sum(o * math.log(o / e) for o, e in zip(cells, expected, strict=True) if o)
            out[d, w] = (tf, df[w], (1 + math.log10(tf)) * math.log10(len(docs) / df[w]), g if tf * total >= len(t) * cf[w] else -g)
    return out


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_scores_whatever_is_broadcast(spark, hot):
    got = distinctive.term_scores(_rows(spark, ROWS), hot_terms=hot).collect()
    want = _scores(ROWS)
    assert {(r["doc_id"], r["term"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        tf, df, weight, llr = want[r["doc_id"], r["term"]]
        assert (r["tf"], r["df"]) == (tf, df)
        assert r["weight"] == pytest.approx(weight) and r["llr"] == pytest.approx(llr, abs=1e-9)


def test_top_terms_ties(spark):
    rows = [(1, "baseline", "a", None, "b a c d"), (2, "baseline", "b", None, "a b c d"), (3, "baseline", "c", None, "z")]
    got = defaultdict(list)
    for r in sorted(distinctive.top_terms(distinctive.term_scores(_rows(spark, rows))).collect(), key=lambda r: r["place"]):
        got[r["doc_id"]].append(r["term"])
    assert got == {"a": ["a", "b", "c"], "b": ["a", "b", "c"]}


def test_rows_that_stay_in_place_are_those_that_count(spark):
    import random

    from glosswork.llm.latest import latest, latest_in_place

    rng = random.Random(4)
    rows = [(k if k % 17 else None, rng.choice(["baseline", "stemming", None]), rng.choice([None, *map(str, range(150))]), [f"t{k}"], "x") for k in range(400)]
    docs = _rows(spark, rows)
    pick = lambda df: sorted(((r["pipeline"] or "", r["doc_id"] or "", r["tokens"][0]) for r in df.collect()))
    one, two = pick(latest(docs.where("row_id is not null"), "tokens")), pick(latest_in_place(docs.where("row_id is not null"), "tokens"))
    assert one == two and len(one) > 200
    assert latest_in_place(docs.where("false"), "tokens").count() == 0
    again = docs.union(docs)
    assert latest_in_place(again, "tokens").count() == latest(again, "tokens").count()


def test_filter_of_fixed_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    from glosswork.llm import bitmap

    rows = spark.range(2000).withColumnRenamed("id", "page_id")
    wanted = spark.range(0, 2000, 40).select(F.col("id").alias("key"))
    for bits in (2**24, 128):
        monkeypatch.setattr(bitmap, "BITS", bits)
        hit = {r["page_id"] for r in bitmap.marked(rows, F.col("page_id"), wanted).where("_marked").collect()}
        assert set(range(0, 2000, 40)) <= hit and (len(hit) < 60 if bits > 128 else len(hit) > 100)
    assert bitmap.marked(rows, F.col("page_id"), wanted.where("false")).where("_marked").count() == 0
    assert bitmap.marked(rows, F.col("page_id"), wanted).columns == ["page_id", "_marked"]


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_runs_over_batch_borders(size):
    import pyarrow as pa

    triples = sorted([(p, t, d) for p in ("a", "b") for t in ("x", "y", "z") for d in ("1", "2", "3") for _ in range(ord(t) % 3 + 1)])
    columns = list(zip(*triples))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in columns], names=["pipeline", "term", "doc_id"]) for k in range(0, len(triples), size)]
    got = {(r["pipeline"], r["term"]): (r["occurrences"], r["records"]) for b in frequency._runs(iter(batches)) for r in b.to_pylist()}
    want = {(p, t): (3 * (ord(t) % 3 + 1), 3) for p in ("a", "b") for t in ("x", "y", "z")}
    assert got == want
