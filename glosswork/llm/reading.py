"""Problem 10: reading level by a latent difficulty model of words and documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.sample import least_hashes
from glosswork.session import cut, written

#: Bound on the labelled documents that the model is fitted on.
MOST_DOCUMENTS = 50_000
#: Words up to which the fitted ones are sent to every worker (16 bytes each); more are joined by word.
BROADCAST_WORDS = 2_000_000
#: Labelled documents that must hold a word; most rounds, and the mean move of a level at which they end.
LEAST_DOCUMENTS, ROUNDS, SETTLED = 3, 8, 0.01
#: Precision of a label, in units of that of the words of its document.
TRUST = 10.0
#: Priors of a word: precision of its difficulty around 0, and of the logarithm of its sharpness around that of ``SHARP``; bounds of the sharpness.
PULL, PULL_SHARP, SHARP, LEAST_SHARP, MOST_SHARP = 1.0, 0.5, 2.0, 0.2, 40.0
#: A document is measured from so many runs of letters.
LEAST_RUNS = 40

_RUNS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"\W?\W?[^\W\d_]+(?:['’\-][^\W\d_]+)*\W{0,3}")
_SEED = 42  # that of the hash function of columns


@dataclass(frozen=True)
class Model:
    """Hash, difficulty and sharpness of each word in the order of the hash; the two cuts between the levels less 2; the words as a table."""

    keys: np.ndarray
    difficulty: np.ndarray
    sharpness: np.ndarray
    low: float = -0.5
    high: float = 0.5
    table: DataFrame | None = field(default=None, compare=False)

    def __len__(self) -> int:
        return len(self.keys)


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """(doc_id, level, text): documents with a valid level, the mean where labels disagree.

    Labels that are null or not 1 to 3 are left out. Beyond ``most`` documents, those with the
    least hash of doc_id are kept; this bounds what the model is fitted on, and nothing else.
    """
    valid = labels.where("level between 1 and 3 and doc_id is not null").groupBy("doc_id").agg(F.avg("level").alias("level"))
    chosen = least_hashes(valid, "doc_id", most, labels.count())
    texts = docs.select("doc_id", "text").where("text is not null")
    return texts.join(F.broadcast(chosen), "doc_id")


def _terms(rows: DataFrame) -> DataFrame:
    """The runs of letters of each text, a row for each: ``rows`` without text, word, key."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    exploded = rows.select(*(c for c in rows.columns if c != "text"), F.explode(runs).alias("word"))
    return exploded.withColumn("key", F.xxhash64("word"))


def difficulties(sample: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(key, word, docs, difficulty, sharpness), fitted by alternating between words and documents.

    The model: the level t of a document that holds a word has the density a * p * (1 - p) with p = 1 / (1 + exp(-a * (t - b))), b
    the word's difficulty and a its sharpness, as if every word were an item of a test that a reader of level t passes with chance p,
    and the document stood where passing and failing are balanced. The product over all
    occurrences of words, with normal priors of b and log a, and the label as a normal prior of t
    (of ``TRUST`` times the precision that the document's words have at first), is one likelihood. Words and documents take Newton steps on it in turn, each step a partial
    aggregate over the pairs, until the levels move by less than ``SETTLED`` on average or ``rounds`` are over.
    A word met at all levels gets a small sharpness and says little. The levels (one row per document of the bounded sample) are broadcast,
    the words if they are few enough.
    """
    pairs = _terms(sample).groupBy("doc_id", "level", "key").agg(F.min("word").alias("word"), F.count("*").alias("n"))
    pairs = written(pairs.withColumn("level", F.col("level") - 2))
    t, n, b, a = F.col("t"), F.col("n"), F.col("difficulty"), F.col("sharpness")
    first = pairs.groupBy("key").agg(F.min("word").alias("word"), F.count("*").alias("docs"), F.sum("level").alias("sum"), F.sum(F.col("level") * F.col("level")).alias("square")).where(F.col("docs") >= LEAST_DOCUMENTS)
    mean = F.col("sum") / F.col("docs")
    spread = F.greatest(F.col("square") / F.col("docs") - mean * mean, F.lit(0.0))
    words = cut(first.select("key", "word", "docs", (F.col("sum") / (F.col("docs") + 1)).alias("difficulty"), F.least(F.greatest(1.8 / F.sqrt(spread + 0.1 + 1 / F.col("docs")), F.lit(LEAST_SHARP)), F.lit(MOST_SHARP)).alias("sharpness")))
    few = words.count() <= BROADCAST_WORDS
    sent = lambda w: F.broadcast(w.select("key", "difficulty", "sharpness")) if few else w.select("key", "difficulty", "sharpness")
    items = pairs.select("doc_id", "key", "n")
    levels = pairs.select("doc_id", "level").distinct().select("doc_id", "level", F.col("level").alias("t"), F.lit(None).cast("double").alias("label"))
    p = 1 / (1 + F.exp(-a * (t - b)))
    z = a * (t - b)
    for left in range(rounds, 0, -1):
        met = items.join(F.broadcast(levels), "doc_id").join(sent(words), "key")
        # documents: slope and bend of the likelihood in t; the label's precision is set in the first round
        slope, bend = F.sum(-n * a * (2 * p - 1)), F.sum(n * a * a * 2 * p * (1 - p))
        moved = met.groupBy("doc_id", "level", "t", "label").agg(slope.alias("slope"), bend.alias("bend")).withColumn("label", F.coalesce("label", F.col("bend") * TRUST))
        step = (F.col("slope") - F.col("label") * (t - F.col("level"))) / (F.col("bend") + F.col("label") + 1e-9)
        levels = cut(moved.select("doc_id", "level", (t + F.greatest(F.least(step, F.lit(0.5)), F.lit(-0.5))).alias("t"), "label", F.abs(step).alias("step")))
        far = levels.agg(F.coalesce(F.avg("step"), F.lit(0.0))).first()[0]
        levels = levels.drop("step")
        # words: the same in b and log a
        met = items.join(F.broadcast(levels), "doc_id").join(sent(words), "key")
        sums = met.groupBy("key").agg(F.sum(n * a * (2 * p - 1)).alias("gb"), F.sum(n * a * a * 2 * p * (1 - p)).alias("hb"), F.sum(n * (1 - z * (2 * p - 1))).alias("ga"), F.sum(n * (z * (2 * p - 1) + 2 * z * z * p * (1 - p))).alias("ha"))
        db = (F.col("gb") - PULL * b) / (F.col("hb") + PULL)
        da = (F.col("ga") - PULL_SHARP * F.log(a / SHARP)) / (F.col("ha") + PULL_SHARP)
        bounded = lambda x: F.greatest(F.least(x, F.lit(0.5)), F.lit(-0.5))
        words = cut(words.join(sums, "key").select("key", "word", "docs", (b + bounded(db)).alias("difficulty"), F.least(F.greatest(a * F.exp(bounded(da)), F.lit(LEAST_SHARP)), F.lit(MOST_SHARP)).alias("sharpness")))
        if far < SETTLED:
            break
    return words


def balance(difficulty: np.ndarray, sharpness: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The most likely level of each of ``n`` texts, for all at once; nan for a text without words.

    The arrays have an element for each word; ``text`` tells whose it is. The likelihood of a level is concave, so the sign of its slope
    brackets the greatest; Newton steps that leave the bracket, and every third one, are halvings of it instead.
    """
    known = np.bincount(text, minlength=n) > 0
    if not len(text):
        return np.full(n, np.nan)
    weight = np.where(known, np.bincount(text, sharpness, n), 1)
    t = np.bincount(text, sharpness * difficulty, n) / weight
    low, high = np.full(n, float(difficulty.min())), np.full(n, float(difficulty.max()))
    a, b, at = sharpness.astype(float), difficulty.astype(float), text
    for k in range(60):
        p = 1 / (1 + np.exp(np.clip(-a * (t[at] - b), -60, 60)))
        slope = np.bincount(at, a * (1 - 2 * p), n)
        bend = np.bincount(at, a**2 * 2 * p * (1 - p), n)
        low, high = np.where(slope > 0, t, low), np.where(slope <= 0, t, high)
        new = t + slope / np.maximum(bend, 1e-12)
        new = np.where((new <= low) | (new >= high) | (k % 3 == 2), (low + high) / 2, new)
        moves = known & (np.abs(slope) > 1e-9 * weight)
        far = moves & (np.abs(new - t) >= 1e-4)
        t = np.where(moves, new, t)
        if not far.any():
            break
        if 2 * far.sum() < known.sum():  # go on with the texts that are not settled
            on = far[at]
            a, b, at, known = a[on], b[on], at[on], far
    return np.where(np.bincount(text, minlength=n) > 0, t, np.nan)


def is_prose(text: str) -> bool:
    """True where most pieces between white space are plain words, with punctuation around them at most."""
    pieces = text.split()
    left, plain = len(pieces) // 2 + 1, _PLAIN.fullmatch
    for k, x in enumerate(pieces):
        if plain(x):
            left -= 1
            if not left:
                return True
        elif left > len(pieces) - k:
            return False
    return False


def _wanted(text: str | None) -> list[str] | None:
    """The runs of letters of a text that is measured, else None."""
    runs = _RUNS.findall(text.lower()) if text else []
    return runs if len(runs) >= LEAST_RUNS and is_prose(text) else None


def _scores(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, difficulty, sharpness = shared.value
        place: dict[str, int] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                at, text = [], []
                for k, body in enumerate(batch.column(1).to_pylist()):
                    found = []
                    for w in _wanted(body) or ():
                        i = place.get(w)
                        if i is None:
                            if len(place) > 400_000:
                                place.clear()
                            h = np.uint64(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), _SEED)).astype(np.int64)
                            i = int(np.searchsorted(keys, h)) if len(keys) else 0
                            i = place[w] = i if i < len(keys) and keys[i] == h else -1
                        if i >= 0:
                            found.append(i)
                    at.extend(found)
                    text.extend([k] * len(found))
                at, text = np.array(at, np.int64), np.array(text, np.int64)
                t = balance(difficulty[at], sharpness[at], text, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.float64(), mask=np.isnan(t))], names=["doc_id", "score"])

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
        b, a = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        t = balance(b, a, np.repeat(np.arange(batch.num_rows), ends), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.float64(), mask=np.isnan(t))], names=["row", "score"])


def _prose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x if _wanted(x) else None for x in batch.column(2).to_pylist()], pa.string())], names=["row", "doc_id", "text"])


def scores(docs: DataFrame, model: Model, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, score) of every document; null where it is too short, no prose, or has no known word.

    A map over the scan with the words sent along; a model of more than ``broadcast_words`` is joined by word instead.
    """
    if len(model) <= broadcast_words:
        shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.difficulty, model.sharpness))
        return docs.select("doc_id", "text").mapInArrow(_scores(shared), "doc_id bigint, score double")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_prose, "row bigint, doc_id bigint, text string"))
    words = _terms(rows.select("row", "text")).select("row", "key")
    met = words.join(model.table.select("key", "difficulty", "sharpness"), "key").groupBy("row").agg(F.collect_list(F.struct("difficulty", "sharpness")).alias("words"))
    return rows.select("row", "doc_id").join(met.mapInArrow(_solve, "row bigint, score double"), "row", "left").select("doc_id", "score")


def cuts(score: np.ndarray, level: np.ndarray) -> tuple[float, float]:
    """The two cuts between neighbouring scores that agree best with the labels; in a tie the middle one."""
    if not len(score):
        return -0.5, 0.5
    order = np.argsort(score, kind="stable")
    score, level = score[order], level[order]
    between = np.concatenate(([score[0] - 0.01], (score[1:] + score[:-1]) / 2, [score[-1] + 0.01]))

    def best(less: np.ndarray) -> float:
        right = np.concatenate(([0], np.cumsum(less))) + np.concatenate((np.cumsum(~less[::-1])[::-1], [0]))
        return float(np.median(between[right == right.max()]))

    low, high = best(level < 1.5), best(level < 2.5)
    return low, max(low, high)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS, rounds: int = ROUNDS) -> Model:
    """The model of the labelled documents. Without valid labels it knows no words.

    Three numbers for each word and two for each document of the bounded sample reach the driver.
    """
    sample = labelled(docs, labels, most)
    words = difficulties(sample, rounds)
    table = words.select("key", "difficulty", "sharpness").toPandas().sort_values("key")
    model = Model(table["key"].to_numpy(np.int64), table["difficulty"].to_numpy(np.float32), table["sharpness"].to_numpy(np.float32), table=words)
    levels = sample.select("doc_id", "level").distinct()
    scored = scores(sample.select("doc_id", "text"), model).where("score is not null").join(levels, "doc_id").select("score", "level").toPandas()
    low, high = cuts(scored["score"].to_numpy(float), scored["level"].to_numpy(float))
    return Model(model.keys, model.difficulty, model.sharpness, low, high, words)


def reading_levels(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, level, score): level 1 to 3 of every document with prose of ``LEAST_RUNS`` runs of letters or more.

    All words of the whole text are weighed, so the level is that of the bulk of it. Null, empty
    and short texts, texts that are no prose and texts without a word that the labelled
    documents hold give no row. Language is not asked for: the words tell. Repeated rows come out each.
    """
    level = F.when(F.col("score") < model.low, 1).when(F.col("score") < model.high, 2).otherwise(3)
    return scores(docs, model).where("score is not null").select("doc_id", level.cast("int").alias("level"), "score")
