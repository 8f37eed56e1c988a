"""Token ids, packing and reading levels."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.llm import packing, reading, tokens

needs_files = pytest.mark.skipif(not os.path.exists(f"{tokens.FOLDER}/{tokens.RANKS}"), reason="no vocabulary files")
ODD = [None, "", " ", "\n\n", "a", "  a  b \t c\n", "<|endoftext|> x", "ž" * 3000, " " * 5000 + "x", "it's  don't", "\x1c\x1d a\x85b", "👍‍🏽 ‍ß", "x" * 20000, "1,234.5 %{}[]", "\xa0\xa0a"]


@needs_files
def test_ids_of_odd_texts(spark):
    whole = tokens.encoder().bpe
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(rows).collect()}
    assert got == {k: whole.encode_ordinary(x) if x else [] for k, x in enumerate(ODD)}
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.lengths(rows).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(rows)).collect()}
    assert back == {k: x or "" for k, x in enumerate(ODD)}
    assert tokens.encode(rows.where("false")).count() == 0


@needs_files
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85\xa0　'sdlv"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_are_safe(text):
    from array import array

    ids = array("i")
    tokens.encoder().into(ids, text)
    assert list(ids) == tokens.encoder().bpe.encode_ordinary(text)
    assert tokens.encoder().decode(list(ids)) == text


@needs_files
def test_partial_bytes_decode():
    ids = tokens.encoder().bpe.encode_ordinary("👍")
    assert len(ids) > 1 and "�" in tokens.encoder().decode(ids[:1])
    assert tokens.encoder().decode(None) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 8))
def test_packer_against_plain_best_fit(sizes, most):
    packer, open_, made = packing.Packer(50, most), [], 0
    for size in sizes:
        number = packer.put(size)
        fits = [b for b in open_ if b[1] >= size]
        if fits:
            space = min(b[1] for b in fits)
            taken = next(b for b in open_ if b[0] == number)
            assert taken[1] == space
            open_.remove(taken)
        else:
            assert number == made
            made, space = made + 1, 50
        if space - size:
            open_.append((number, space - size))
        if len(open_) > most:
            least = min(b[1] for b in open_)
            closed = [b for b in open_ if b[1] == least]
            shut = [b for b in closed if b[0] not in packer.bins.get(b[1], [])]
            open_.remove(shut[0])
        assert sorted(n for stack in packer.bins.values() for n in stack) == sorted(b[0] for b in open_)


def test_packing_is_whole(spark):
    rng = random.Random(6)
    sizes = [(k, rng.randrange(0, 900)) for k in range(3000)] + [(9000, 5000), (9001, None), (9002, 0), (9000, 5000)]
    docs = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([("s", 512), ("s", 512), ("l", 2048), ("bad", 0), ("null", None)], "container_type string, capacity int")
    packed = packing.pack(docs, kinds, stream_items=800).cache()
    for kind, capacity in (("s", 512), ("l", 2048)):
        rows = packed.where(F.col("container_type") == kind).collect()
        assert sum(r["size"] for r in rows) == sum(n or 0 for _, n in sizes)
        assert all(0 <= r["size"] <= capacity for r in rows)
        used = {}
        for r in rows:
            used[r["container"]] = used.get(r["container"], 0) + r["size"]
        assert max(used.values()) <= capacity
        whole = {k: n or 0 for k, n in sizes if (n or 0) <= capacity}
        parts = {}
        for r in rows:
            parts.setdefault(r["doc_id"], []).append(r["size"])
        assert all(parts[k] == [n] for k, n in whole.items())
        assert sum(parts[9000]) == 10000
    assert {r["container_type"] for r in packed.collect()} == {"s", "l"}
    good = {r["container_type"]: r["fill"] for r in packing.fill(packed).collect()}
    assert good["l"] > 0.93
    again = packing.pack(docs.repartition(7), kinds, stream_items=800)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed.collect()))
    assert packing.pack(docs.where("false"), kinds).count() == 0


def test_hot_ids_are_spread_over_streams(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 300)
    sizes = [(None, 7)] * 1000 + [(5, 9)] * 1000 + [(k, 3) for k in range(100, 1100)]
    docs = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    rows = packing.pack(docs, spark.createDataFrame([("s", 64)], "container_type string, capacity int"), stream_items=150).collect()
    for doc, n in ((None, 1000), (5, 1000)):
        own = [r["container"] >> 40 for r in rows if r["doc_id"] == doc]
        assert len(own) == n and len(set(own)) == 20 and max(map(own.count, set(own))) < 100
    assert len(rows) == 3000


EASY = "the dog sees a red ball and the cat has a small hat on the bed near a tree".split()
PLAIN = "our town council opened another weekend market because visitors expected cheaper tickets during summer".split()
HARD = "methodological ambiguity determines hierarchical categorisation whereas epistemological uncertainty modifies empirical verifiability".split()


def _document(rng, words, n=60):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def test_reading_levels_of_held_out_documents(spark):
    rng = random.Random(9)
    rows, labels, truth = [], [], {}
    for k in range(300):
        level = k % 3 + 1
        main, other = (EASY, PLAIN, HARD)[level - 1], (EASY, PLAIN, HARD)[rng.randrange(3)]
        rows.append((k, _document(rng, main, 70) + " " + _document(rng, other, 25), "en"))
        truth[k] = level
        if k < 150:
            labels.append((k, level if rng.random() > 0.05 else level % 3 + 1))
    labels += [(0, None), (1, 9), (None, 2), (777, 1)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "one", "en"), (903, "x=1; y[2]=f(x){z}; " * 60, "en"), (904, "qq ww ee rr " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, level string")
    marks = spark.createDataFrame(labels, "doc_id bigint, level int")
    model = reading.fit(docs, marks)
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(docs, model).collect()}
    assert set(got) == set(truth)
    assert sum(got[k] == truth[k] for k in range(150, 300)) >= 140
    joined = {r["doc_id"]: r["score"] for r in reading.scores(docs, model, broadcast_words=3).collect()}
    mapped = {r["doc_id"]: r["score"] for r in reading.scores(docs, model).collect()}
    assert set(joined) == set(mapped) and all((x is None) == (joined[k] is None) and (x is None or abs(x - joined[k]) < 1e-3) for k, x in mapped.items())
    words = {r["word"]: r["difficulty"] for r in reading.difficulties(reading.labelled(docs, marks)).collect()}
    assert words["dog"] < words["market"] < words["epistemological"]


def test_balance_is_the_most_likely_level():
    rng = np.random.RandomState(3)
    text = np.sort(rng.randint(0, 20, 400))
    b, a = rng.uniform(-1.5, 1.5, 400), rng.uniform(0.3, 30, 400)
    grid = np.linspace(-2, 2, 4001)
    z = a[:, None] * (grid[None, :] - b[:, None])
    each = -np.logaddexp(0, z) - np.logaddexp(0, -z)
    for k, t in enumerate(reading.balance(b, a, text, 20)):
        assert abs(t - grid[each[text == k].sum(axis=0).argmax()]) < 2e-3
    assert np.isnan(reading.balance(b[:0], a[:0], text[:0], 2)).all()


def test_reading_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40)], "doc_id bigint, text string")
    model = reading.fit(docs, spark.createDataFrame([], "doc_id bigint, level int"))
    assert len(model) == 0 and reading.reading_levels(docs, model).count() == 0


def test_bound_on_the_sample(spark):
    docs = spark.createDataFrame([(k, "text") for k in range(50)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(k, 1) for k in range(50)], "doc_id bigint, level int")
    assert reading.labelled(docs, marks, 20).count() == 20
