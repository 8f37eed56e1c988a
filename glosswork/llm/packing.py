"""Problem 9: items into containers of fixed capacity, by bounded-space best fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.session import cut

#: Bins that are open at once in a task.
OPEN_BINS = 64
#: Items that one stream of a container type takes on average; streams run side by side.
STREAM_ITEMS = 20_000
#: Equal rows that one task deals out at most.
COPIES = 100_000


class Packer:
    """Online best fit over at most ``open_bins`` open bins of one capacity.

    Bit f of ``free`` is set while a bin with f units of free space is open, so the best
    bin for an item is the lowest set bit at or above its size. When one bin too many is
    open, the fullest closes first.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bins, self.n_open, self.made = 0, {}, 0, 0

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.n_open -= 1
        return number

    def _leave(self, number: int, space: int) -> None:
        if space == 0:
            return
        self.bins.setdefault(space, []).append(number)
        self.free |= 1 << space
        self.n_open += 1
        if self.n_open > self.open_bins:
            self._take((self.free & -self.free).bit_length() - 1)

    def put(self, size: int) -> int:
        """The number of the bin that takes an item of ``size``, at most the capacity."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.made
            self.made += 1
        self._leave(number, space - size)
        return number


_SCHEMA = "container_type string, capacity int, container bigint, doc_id bigint, part int, size int"


def _pack(open_bins: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers: dict[tuple, Packer] = {}
        for frame in frames:
            rows = []
            for kind, capacity, stream, doc_id, tokens in zip(*(frame[c].tolist() for c in ("container_type", "capacity", "stream", "doc_id", "tokens")), strict=True):
                packer = packers.get((kind, capacity, stream))
                if packer is None:
                    packer = packers[kind, capacity, stream] = Packer(capacity, open_bins)
                part = 0
                while True:
                    size = min(tokens, capacity)
                    rows.append((kind, capacity, stream * 2**40 + packer.put(size), doc_id, part, size))
                    tokens -= size
                    part += 1
                    if tokens <= 0:
                        break
            yield pd.DataFrame(rows, columns=["container_type", "capacity", "container", "doc_id", "part", "size"])

    return run


def pack(sizes: DataFrame, containers: DataFrame, open_bins: int = OPEN_BINS, stream_items: int = STREAM_ITEMS) -> DataFrame:
    """(container_type, capacity, container, doc_id, part, size): every item in a container of each type.

    ``sizes`` holds (doc_id, tokens). Equal rows are counted first; then items are dealt by a hash of (doc_id, tokens, number among equal
    rows) to streams of about ``stream_items``, whose number follows the number of items, so the unused space
    of the bins left open at a stream's end stays a fixed small share at every scale, and rows without doc_id or with one that
    repeats are spread like others. A stream takes its items in ascending order of (hash, doc_id), which makes the result
    the same on every run. Only (doc_id, tokens) moves; it is kept in
    the checkpoint folder first, so that texts are measured once.

    An item larger than the capacity is split into full containers' worth and a remainder, numbered
    by part; any other item has the single part 0. Items of size 0 or null take size 0 in
    the fullest open container. Capacities that are null or not positive are left out, doubled
    types count once. Rows that repeat a doc_id are packed each. Containers are numbered apart for every
    (container_type, capacity).
    """
    counted = cut(sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).groupBy("doc_id", "tokens").agg(F.count("*").alias("copies")))
    kinds = containers.select("container_type", F.col("capacity").cast("int").alias("capacity")).where("capacity > 0").distinct()
    streams = counted.agg(F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum("copies"), F.lit(0)) / F.lit(stream_items))).cast("bigint").alias("streams"))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))).alias("from")).repartition("doc_id", "tokens", "from")
    single = parts.select("doc_id", "tokens", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "copies") - 1)).alias("copy"))
    items = single.select("doc_id", "tokens", F.xxhash64("doc_id", "tokens", "copy").alias("h"))
    dealt = items.crossJoin(F.broadcast(streams)).crossJoin(F.broadcast(kinds)).withColumn("stream", F.pmod("h", "streams"))
    keys = ["container_type", "capacity", "stream"]
    ordered = dealt.select(*keys, "h", "doc_id", "tokens").repartition(*keys).sortWithinPartitions(*keys, "h", "doc_id", "tokens").drop("h")
    return ordered.mapInPandas(_pack(open_bins), _SCHEMA)


def fill(packed: DataFrame) -> DataFrame:
    """(container_type, capacity, containers, items, used, fill, least): how well each type is filled.

    least is the number of containers that the sizes need at the very least.
    """
    used = F.sum("size")
    bins = packed.groupBy("container_type", "capacity", "container").agg(used.alias("used"), F.count("*").alias("items"))
    total = bins.groupBy("container_type", "capacity").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used"))
    return total.select("*", (F.col("used") / (F.col("containers") * F.col("capacity"))).alias("fill"), F.ceil(F.col("used") / F.col("capacity")).alias("least"))
