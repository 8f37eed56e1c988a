"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.session import cut


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round: link the neighbours of each node to the least node seen there.

    ``edges`` holds (u, v) with u > v. The minimum is a partial aggregate; it is
    joined back rather than collected, so no neighbourhood sits in one row.
    """
    if larger:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if larger:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` is linked to.

    Edges are undirected; loops, repeats and edges with a null end are ignored.
    Only nodes with at least one edge to another node appear. Nodes must be of
    one orderable type. An empty edge table gives no rows. Every round is written
    to the checkpoint folder. Raises if ``most_rounds`` do not suffice (the
    rounds needed grow with the logarithm of the longest chain).
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = cut(pair.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct())
    sign = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = sign(now)
    for _ in range(most_rounds):
        now = cut(_star(_star(now, True), False))
        after = sign(now)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError("components did not settle; raise most_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
