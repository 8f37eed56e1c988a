"""Bounded samples that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashes(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """At most ``most`` of ``rows``: those with the least hash of ``key``.

    ``total`` is about the number of rows. Rows whose hash is far too large to be among the least are dropped where
    they are read, so each task sends on its share of the sample and not a sample of its own.
    """
    share = min(1.0, 4 * most / max(1, total))
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    return rows.where(F.xxhash64(key) <= F.lit(bound)).orderBy(F.xxhash64(key), key).limit(most)
