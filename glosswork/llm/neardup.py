"""Problem 2: near-duplicate pages by an LSH forest over word shingles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import has_text
from glosswork.llm.bitmap import marked
from glosswork.llm.hashing import WordHashes, hash64, signed
from glosswork.operators.graph import components
from glosswork.session import cut, written

#: Sorted orders (trees); each sorts by two hashes of 32 bits.
TREES = 24
#: Rows with one equal hash up to which all of them are neighbours; beyond, two equal hashes are needed.
SPARSE = 32
#: Rows with two equal hashes beyond which a region is compared in blocks, rows of such a block; two blocks make one task.
REGION, BLOCK = 512, 4096
#: Bits of the sketch that travels with each row, and those that may differ. Of two texts with half of their shingles
#: in common a quarter of the bits differ on average; more than so many do with a chance of about 1 in 800.
SKETCH, MOST_BITS = 192, 66
#: Share of the texts from which hot keys are told, and bound on their number. This places rows, it drops none.
SAMPLE, HOT_KEYS = 64, 20_000

_WORD = re.compile(r"[^\W_]+")


class _Hasher:
    """Words of a text as numbers; shingles, minima and sketches from them."""

    def __init__(self) -> None:
        self.numbers = WordHashes()
        draw = np.random.RandomState(20240607)
        n = TREES * 2 + SKETCH
        self.factor = (draw.randint(1, 2**31, n).astype(np.uint64) * 2 + 1)[:, None].astype(np.uint32)
        self.offset = draw.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def words(self, text: str) -> np.ndarray:
        return self.numbers.of(_WORD.findall(text.lower()))

    @staticmethod
    def shingles(words: np.ndarray, width: int) -> np.ndarray:
        """Distinct 64-bit hashes of the runs of ``width`` words; of the whole text if it is shorter."""
        width = min(width, len(words))
        if not width:
            return np.zeros(0, np.uint64)
        total = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            total = (total ^ (words[j : len(words) - width + 1 + j] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(29)
        return np.unique(total)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The least value of each hash function over the shingles, in slices so that long texts stay small in memory."""
        x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.factor), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 1024):
            part = x[None, at : at + 1024] * self.factor + self.offset
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(least, part.min(axis=1), out=least)
        return least


@lru_cache(maxsize=1)
def _hasher() -> _Hasher:
    return _Hasher()


def _class(words: np.ndarray) -> int:
    """64 bits for a text's sequence of words; equal texts up to case and punctuation are one class."""
    return signed(hash64(words.tobytes()))


def _bit(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum that all of its bits decide."""
    mixed = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (mixed >> np.uint32(31)).astype(np.uint8)


_ROW = "tree tinyint, h1 int, h2 int, class bigint, s1 bigint, s2 bigint, s3 bigint"
_PARTS = ["s1", "s2", "s3"]
_NAMES = ["tree", "h1", "h2", "class", *_PARTS]


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)


def _sign(least_words: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per page a row of tree -1 with its class and, as s1, its id; per class that the task meets first, a row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, met = _hasher(), set()
        for batch in batches:
            pages, classes, own, rows = [], [], [], []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = hasher.words(text)
                if len(words) < least_words:
                    continue
                name = _class(words)
                pages.append(page)
                classes.append(name)
                if name in met:
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(name)
                own.append(name)
                rows.append(hasher.minima(hasher.shingles(words, width)))
            n = len(pages)
            none = np.zeros(n, np.int32)
            yield _batch(np.full(n, -1, np.int8), none, none, np.array(classes, np.int64), np.array(pages, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))
            if own:
                table = np.array(rows, dtype=np.uint32)
                n = len(own)
                orders = table[:, : TREES * 2].reshape(n * TREES, 2).view(np.int32)
                sketch = np.packbits(_bit(table[:, TREES * 2 :]), axis=1).view(np.int64)
                repeat = lambda x: np.repeat(x, TREES)
                yield _batch(np.tile(np.arange(TREES, dtype=np.int8), n), orders[:, 0].copy(), orders[:, 1].copy(), repeat(np.array(own, np.int64)), *(repeat(sketch[:, k]) for k in range(len(_PARTS))))

    return run


def signed_pages(pages: DataFrame, least_words: int = 60, width: int = 3) -> DataFrame:
    """One pass over the texts, written once: the class of each page (tree -1) and the signature rows of each class.

    Pages with the same words in order share a class, told by 64 bits.
    """
    kept = pages.select("page_id", "article_text").where(F.col("page_id").isNotNull() & has_text(F.col("article_text")))
    return written(kept.mapInArrow(_sign(least_words, width), _ROW))


def members(rows: DataFrame) -> DataFrame:
    """(page_id, class) of ``signed_pages``; a page_id that repeats has a row for each of its texts."""
    return rows.where("tree = -1").select(F.col("s1").alias("page_id"), "class").distinct()


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which two sketches differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1)


def _within(name: np.ndarray, sketch: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with close sketches of each row i with the rows up to ``end[i]``, for all regions at once."""
    left, right = [name[:0]], [name[:0]]
    open_, step = np.flatnonzero(np.arange(len(name)) + 1 < end), 1
    while len(open_):
        near = open_[_differ(sketch[open_], sketch[open_ + step]) <= MOST_BITS]
        left.append(name[near])
        right.append(name[near + step])
        step += 1
        open_ = open_[open_ + step < end[open_]]
    return np.concatenate(left), np.concatenate(right)


def _across(name: np.ndarray, sketch: np.ndarray, other: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with close sketches of each row of one block with each of another."""
    left, right = [name[:0]], [other[:0]]
    step = max(1, 1_000_000 // max(1, len(other)))
    for at in range(0, len(name), step):
        i, j = np.nonzero(_differ(sketch[at : at + step, None, :], others[None, :, :]) <= MOST_BITS)
        left.append(name[i + at])
        right.append(other[j])
    return np.concatenate(left), np.concatenate(right)


_FOUND = "a bigint, b bigint, tree tinyint, h1 int, h2 int, s1 bigint, s2 bigint, s3 bigint"


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), k) for k in (pa.int8(), pa.int32(), pa.int32(), *[pa.int64()] * len(_PARTS))]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *none], names=["a", "b", *_NAMES[:3], *_PARTS])


def _row_batch(parts: list[np.ndarray]) -> pa.RecordBatch:
    tree, h1, h2, name, *sketch = parts
    return pa.RecordBatch.from_arrays([pa.array(name), pa.nulls(len(name), pa.int64()), *map(pa.array, (tree, h1, h2, *sketch))], names=["a", "b", *_NAMES[:3], *_PARTS])


def _new(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    for k, c in enumerate(columns):
        out[1:] = (c[1:] != c[:-1]) if k == 0 else out[1:] | (c[1:] != c[:-1])
    return out


def _ends(starts: np.ndarray) -> np.ndarray:
    """For each row the end of its run, from the marks of the runs' starts."""
    at = np.append(np.flatnonzero(starts), len(starts))
    return np.repeat(at[1:], np.diff(at))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan of the sorted orders: candidates with a common prefix, and the rows (b null) of regions that are compared in blocks.

    The depth is the region's own: rows with one equal hash are neighbours if there are at most ``SPARSE`` of them (``deep`` marks
    keys that are known to have more), else those with two. What is not ended yet waits for the next batch, at most ``REGION`` rows beyond it.
    """
    held: list[np.ndarray] | None = None
    large: tuple | None = None  # (tree, h1) with more than SPARSE rows
    dense: tuple | None = None  # (tree, h1, h2) with more than REGION rows

    def scan(parts: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, large, dense
        fresh = _new(*parts[:4])  # copies that several tasks saw
        parts = [x[fresh] for x in parts]
        tree, h1, h2, name, *sketch, deep = parts
        n = len(name)
        index = np.arange(n)
        shallow = _new(tree, h1, np.where(deep, h2, 0))
        end = _ends(shallow)
        start = np.maximum.accumulate(np.where(shallow, index, 0))
        more = deep | (end - start > SPARSE)
        if large is not None:
            more |= (tree == large[0]) & (h1 == large[1])
        two = _new(tree, h1, h2)
        end2 = _ends(two)
        start2 = np.maximum.accumulate(np.where(two, index, 0))
        passed = more & (end2 - start2 > REGION)
        if dense is not None:
            passed |= (tree == dense[0]) & (h1 == dense[1]) & (h2 == dense[2])
        reach = np.where(passed, index, np.where(more, end2, end))
        wait = n
        if not last:
            large = (tree[-1], h1[-1]) if more[-1] else None
            dense = (tree[-1], h1[-1], h2[-1]) if passed[-1] else None
            wait = n if passed[-1] else int(start2[-1] if more[-1] else start[-1])
        if passed[:wait].any():
            yield _row_batch([x[:wait][passed[:wait]] for x in (tree, h1, h2, name, *sketch)])
        if wait:
            a, b = _within(name[:wait], np.stack(sketch, axis=1).view(np.uint64)[:wait], np.minimum(reach[:wait], wait))
            yield _pair_batch(a[a != b], b[a != b])
        held = [x[wait:] for x in parts]

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*_NAMES, "deep")]
        if held is not None and len(held[0]):
            parts = [np.concatenate([x, y]) for x, y in zip(held, parts, strict=True)]
        yield from scan(parts, False)
    if held is not None and len(held[0]):
        yield from scan(held, True)


def _compare(group: pa.Table) -> pa.Table:
    """Candidates between two blocks of one large region, or within one."""
    name, low = group.column("a").to_numpy(), group.column("low").to_numpy()
    block, high = group.column("block").to_numpy(), group.column("high").to_numpy()
    sketch = np.stack([group.column(c).to_numpy() for c in _PARTS], axis=1).view(np.uint64)
    if low[0] == high[0]:
        a, b = _within(name, sketch, np.full(len(name), len(name)))
    else:
        on = block == low[0]
        a, b = _across(name[on], sketch[on], name[~on], sketch[~on])
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): candidates of the large regions, every row against every other, each pair of blocks as a group of its own."""
    key = ["tree", "h1", "h2"]
    regions = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(regions, key).withColumn("block", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = met.select(*key, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "a", *_PARTS)
    return pairs.groupBy(*key, "low", "high").applyInArrow(_compare, "a bigint, b bigint")


def _hot(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of one hash, and of two, that very many rows have, as a sample of the texts tells; at most ``HOT_KEYS`` each."""
    seen = cut(rows.where(F.pmod(F.xxhash64("class"), F.lit(SAMPLE)) == 0).groupBy("tree", "h1", "h2").agg(F.count("*").alias("n")))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(2 * REGION // SAMPLE + 16, -(-total // HOT_KEYS))
    one = seen.groupBy("tree", "h1").agg(F.sum("n").alias("n")).where(F.col("n") >= bound).select("tree", "h1", F.lit(True).alias("deep"))
    two = seen.where(F.col("n") >= bound).select("tree", "h1", "h2", F.lit(True).alias("hot"))
    return one, two


def candidates(signed_rows: DataFrame) -> DataFrame:
    """(a, b): pairs of classes that are neighbours in one of the sorted orders and have close sketches, each once.

    Rows meet by (tree, first hash); where that key is hot, by both hashes; where both are, in salted blocks.
    """
    rows = signed_rows.where("tree >= 0")
    one, two = _hot(rows)
    told = rows.join(F.broadcast(one), ["tree", "h1"], "left").join(F.broadcast(two), ["tree", "h1", "h2"], "left")
    told = told.select(*_NAMES, F.coalesce("deep", F.lit(False)).alias("deep"), F.coalesce("hot", F.lit(False)).alias("hot"))
    spread = F.when(F.col("deep"), F.col("h2")).otherwise(0)
    ordered = told.where("not hot").drop("hot").repartition("tree", "h1", spread).sortWithinPartitions("tree", "h1", "h2", "class")
    found = cut(ordered.mapInArrow(_neighbours, _FOUND).distinct())
    pairs = found.where("b is not null").select("a", "b")
    large = found.where("b is null").drop("b").unionByName(told.where("hot").select(F.col("class").alias("a"), "tree", "h1", "h2", *_PARTS).distinct())
    if large.isEmpty():
        return pairs
    return cut(pairs.union(_block_pairs(large)).distinct())


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own, names = [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = hasher.words(text)
                    if _class(words) == name:  # else another text under the same page_id
                        names.append(name)
                        own.append(hasher.shingles(words, width))
                flat = np.concatenate([*own, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["class", "shingles"])

    return run


def similar_classes(pages: DataFrame, signed_rows: DataFrame, member: DataFrame, width: int = 3, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity): classes whose sets of runs of ``width`` words overlap by ``threshold`` or more of their union."""
    pairs = candidates(signed_rows)
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    first = cut(member.join(needed, "class", "left_semi").groupBy("class").agg(F.min("page_id").alias("page_id")))
    kept = pages.select("page_id", "article_text").where(has_text(F.col("article_text")))
    near = marked(kept, F.col("page_id"), first.select(F.col("page_id").alias("key"))).where("_marked").drop("_marked")  # so that most texts do not move
    texts = near.join(first, "page_id").select("class", "article_text")
    sets = cut(texts.mapInArrow(_sets(width), "class bigint, shingles array<bigint>").dropDuplicates(["class"]))
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    measured = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("n"), (F.size("x") + F.size("y")).alias("all"))
    return measured.select("a", "b", (F.col("n") / (F.col("all") - F.col("n"))).alias("similarity")).where(F.col("similarity") >= threshold)


def near_pairs(pages: DataFrame, width: int = 3, threshold: float = 0.5, least_words: int = 60) -> DataFrame:
    """(page_id_a, page_id_b): all pairs of pages with similar text, the smaller id first, each once.

    Pages whose words are the same in order are one class, which is signed once per task
    however many copies there are. The classes are sorted by ``TREES`` independent
    orders of min-hash signatures. Those that share the first hash of an order are its neighbours; in a dense region the
    common prefix must be two hashes long, and a region that is dense even so is compared whole, in blocks of rows. A sketch of
    ``SKETCH`` bits sorts out chance neighbours before anything else moves; what is left is
    measured exactly on the whole texts, of which only those needed move. Last, classes are opened to their members,
    as each pair of pages is asked for.

    Pages without text (null, blank, the crawler's default), with fewer than ``least_words``
    words or without page_id give no pairs. An empty table gives no rows. The search is probabilistic: a pair at
    the threshold is missed with a chance below one in two hundred, closer pairs much more rarely.
    """
    rows = signed_pages(pages, least_words, width)
    member = members(rows)
    alike = similar_classes(pages, rows, member, width, threshold)
    left = member.select(F.col("page_id").alias("p"), F.col("class").alias("a"))
    right = member.select(F.col("page_id").alias("q"), F.col("class").alias("b"))
    across = alike.select("a", "b").join(left, "a").join(right, "b").select("p", "q")
    within = left.join(right.withColumnRenamed("b", "a"), "a").where("p < q").select("p", "q")
    return across.unionByName(within).where("p <> q").select(F.least("p", "q").alias("page_id_a"), F.greatest("p", "q").alias("page_id_b"))


def groups(pages: DataFrame, width: int = 3, threshold: float = 0.5, least_words: int = 60) -> DataFrame:
    """(page_id, group_id, links): one row per page with text enough.

    group_id is the least page_id that the page is linked to over any number of similar
    texts, its own if none; links counts the other classes (different texts) that its text is similar to.
    """
    rows = signed_pages(pages, least_words, width)
    member = members(rows)
    alike = cut(similar_classes(pages, rows, member, width, threshold).select("a", "b"))
    links = alike.select(F.col("a").alias("class")).union(alike.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    group = components(alike)
    rooted = member.join(group.withColumnRenamed("node", "class"), "class", "left").select("page_id", "class", F.coalesce("component", "class").alias("root"))
    least = rooted.groupBy("root").agg(F.min("page_id").alias("group_id"))
    return rooted.join(least, "root").join(links, "class", "left").select("page_id", "group_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
