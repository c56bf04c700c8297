"""Positional operators: numbering, carrying forward, islands, even splits, repairs.

Windows are partitioned by a key of the data; none orders a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumber(df: DataFrame, group: list[str], order: list[str], out: str = "n") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def end_before_next(df: DataFrame, group: list[str], start: str, last: str, out: str = "end_at") -> DataFrame:
    """A range ends one before the next start, the last one at ``last``."""
    following = F.lead(start).over(Window.partitionBy(*group).orderBy(start))
    return df.withColumn(out, F.coalesce(following - 1, F.col(last)))


def carry_forward(value: Column, group: list[str], order: list[str]) -> Column:
    return F.last(value, True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def segments(df: DataFrame, group: list[str], order: str, is_marker: Column, text: str, joiner: str = " ") -> DataFrame:
    """Text between markers: a running count of markers numbers the segment, its lines are joined in order."""
    number = F.sum(is_marker.cast("int")).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    numbered = df.withColumn("segment", number)
    lines = F.array_sort(F.collect_list(F.struct(order, text)))
    return numbered.groupBy(*group, "segment").agg(F.array_join(F.transform(lines, lambda x: x[text]), joiner).alias("body"))


def islands(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Runs of consecutive values as (low, high, n); n counts a repeated value once, a null value is a run by itself.

    One sort, which can spill: the first row of a run takes its end from the next first row, so nothing is hashed.
    """
    at = Window.partitionBy(*group).orderBy(value)
    own = df.select(*group, F.col(value).alias("low"), F.lag(value).over(at).alias("_before"), F.row_number().over(at).alias("_nth"))
    fresh = (F.col("_nth") == 1) | ~F.col("low").eqNullSafe(F.col("_before"))
    start = (F.col("_nth") == 1) | (fresh & (F.col("_before").isNull() | (F.col("low") - F.col("_before") > 1)))
    whole = Window.partitionBy(*group).orderBy("low", "_nth")
    until = whole.rowsBetween(Window.unboundedPreceding, 0)
    # the last row of a group is marked, as no first row comes behind the last run
    marked = own.select("*", start.alias("_start"), F.sum(fresh.cast("long")).over(until).alias("_count"), F.lead("_nth").over(whole).isNull().alias("_last"))
    ends = marked.where(F.col("_start") | F.col("_last"))
    following = lambda c: F.lead(c).over(whole)
    own_end = F.col("_last") & F.col("_start")
    ends = ends.select(*group, "low", "_start", F.when(own_end, F.col("low")).when(following("_start"), following("_before")).otherwise(following("low")).alias("high"), (F.when(own_end, F.col("_count")).when(following("_start"), following("_count") - 1).otherwise(following("_count")) - F.col("_count") + 1).alias("n"))
    return ends.where("_start").select(*group, "low", "high", "n")


def merge_intervals(df: DataFrame, group: list[str], start: str, end: str, tie: str, gap: int = 1) -> DataFrame:
    """Merges intervals that overlap or lie at most ``gap`` apart."""
    w = Window.partitionBy(*group).orderBy(start, end, tie)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    numbered = df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "island").agg(F.min(start).alias("low"), F.max(end).alias("high"), F.count("*").alias("n")).drop("island")


def even_split(df: DataFrame, group: list[str], order: list[str], parts: int, out: str = "bucket") -> DataFrame:
    """As even as can be, larger parts first."""
    return df.withColumn(out, F.ntile(parts).over(Window.partitionBy(*group).orderBy(*order)))


def look_ahead(value: Column, group: list[str], order: str, rows: int) -> Column:
    """The next value that is not null within so many rows."""
    return F.first(value, True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(1, rows))


def looked_back(value: Column, group: list[str], order: str, rows: int) -> Column:
    """The values of so many rows before, in order."""
    return F.collect_list(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(-rows, -1))


def last_not_blank(text: str, group: list[str], order: str) -> Column:
    return F.last(F.nullif(F.trim(text), F.lit("")), True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def top_k(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a full order."""
    return top_k(df, key, order, 1).drop("rank")


def not_increasing(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return df.withColumn("before", before).where(F.col(value) <= F.col("before"))


def repair_ranges(ranges: Column, last: Column) -> Column:
    """Array of (s, e): the last one ends at ``last``, each begins after the one before ended, none is inverted, the first begins at 1."""
    n = F.size(ranges)
    made = F.transform(ranges, lambda r, i: F.struct(r["s"].alias("s"), F.when(i == n - 1, last).otherwise(r["e"]).alias("e")))

    def step(done, r):
        end = F.element_at(done, -1)["e"]
        s = F.when((F.size(done) > 0) & (r["s"] <= F.when(F.size(done) > 0, end)), F.when(F.size(done) > 0, end) + 1).otherwise(r["s"])
        e = F.when((F.size(done) > 0) & (r["e"] < s), s).otherwise(r["e"])
        return F.concat(done, F.array(F.struct(s.alias("s"), e.alias("e"))))

    empty = F.array().cast("array<struct<s:int,e:int>>")
    fixed = F.aggregate(made, empty, step)
    return F.transform(fixed, lambda r, i: F.struct(F.when(i == 0, 1).otherwise(r["s"]).alias("s"), r["e"].alias("e")))


def runs_or_longest(df: DataFrame, group: list[str], key: str, order: str, text: str) -> DataFrame:
    """Per key: rows in one unbroken run are joined in order; of several runs the longest text stays, the first on a tie."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - F.row_number().over(Window.partitionBy(*group, key).orderBy(order))
    runs = df.withColumn("run", at).groupBy(*group, key, "run").agg(F.min(order).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("body"))
    return runs.groupBy(*group, key).agg(F.count("*").alias("runs"), F.max_by("body", F.struct(F.length("body"), -F.col("first"))).alias("body"))


def join_with_next(df: DataFrame, group: list[str], order: str, text: str, joins: Column) -> DataFrame:
    """Where ``joins`` holds, a row ends with the next row's text; rows so used up go."""
    w = Window.partitionBy(*group).orderBy(order)
    marked = df.withColumn("joins", F.coalesce(joins, F.lit(False)) & F.lead(text).over(w).isNotNull())
    marked = marked.withColumn("chain", F.sum(F.when(F.coalesce(F.lag("joins").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return marked.groupBy(*group, "chain").agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda x: x[text]), " ").alias(text), F.count("*").alias("parts")).drop("chain")


def running_max_accept(df: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """Greedy monotone acceptance: a row stays if its key is not below any key before it."""
    before = F.max(key).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).where(F.col("before").isNull() | (F.col(key) >= F.col("before"))).drop("before")
