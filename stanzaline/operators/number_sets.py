"""Exact sets of whole numbers as bitmaps, which are built before a shuffle and merge afterwards.

A set is a row for each range of 32,768 numbers in which it has any, with one bit for each of them. So what is
shuffled and stored for a dense set is 4 KB for each range and task, where distinct rows would be one for each
number; sets of a few scattered numbers are better kept as rows.

Defined cases: null numbers are in no set, but the keys of a group that has no others stay, with an empty set; negative
numbers and zero are numbers like any other; repeated rows count once; an empty table has no sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, range, bits): the set of numbers of each group."""
    at = F.col(number).cast("long")
    return rows.groupBy(*keys, F.bitmap_bucket_number(at).alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def union(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Sets merged over all columns but ``keys``."""
    return sets.groupBy(*keys, "range").agg(F.bitmap_or_agg("bits").alias("bits"))


def count(sets: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """How many numbers each group's set has; of sets of one group that are not merged yet, how many they have in all."""
    return union(sets, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def _has(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0


def missing(sets: DataFrame, keys: list[str], low: int, high: int, name: str) -> DataFrame:
    """The numbers from ``low`` to ``high`` that each group's set lacks."""
    every = sets.sparkSession.range(low, high + 1).select(F.col("id").alias(name), F.bitmap_bucket_number("id").alias("range"))
    # the groups are known by their keys; a range in which one has nothing has no row
    asked = union(sets, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("range").isNotNull(), F.struct("range", "bits")))).alias("_bits"))
    spread = asked.select(*keys, "_bits", F.explode(F.sequence(F.lit(_range(low)).cast("long"), F.lit(_range(high)).cast("long"))).alias("range"))
    met = spread.select(*keys, "range", F.try_element_at("_bits", F.col("range")).alias("_own")).join(every, "range")
    return met.where(F.col("_own").isNull() | ~_has(F.col("_own"), F.bitmap_bit_position(name))).select(*keys, name)


def _range(number: int) -> int:
    """Number of a range as Spark counts them: from 1 for positive numbers, towards zero for others."""
    return 1 + (number - 1) // 32_768 if number > 0 else -(-number // 32_768)
