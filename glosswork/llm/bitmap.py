"""A filter of fixed size that tells which rows may have one of many keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, 64 to a row of the table that is broadcast: at most 262,144 rows, whatever the number of keys.
BITS = 2**24


def marked(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` with _marked: true for all whose ``key`` is among the ``key`` of ``wanted``, and for some others by chance.

    Keys are 64-bit numbers. The share that is marked by chance is about that of the bits that are set; as it nears one, the filter
    saves nothing, but what is built on it stays right.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(BITS))
    bits = wanted.select(place(F.col("key")).alias("_at")).select(F.shiftright("_at", 6).alias("_word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("_bit"))
    table = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_at", place(key)).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(table), "_word", "left")
    hit = F.expr("_bits is not null and (shiftrightunsigned(_bits, cast(_at % 64 as int)) & 1L) = 1L")
    return met.select(*rows.columns, hit.alias("_marked"))
