"""Data-quality checks; each returns what is wrong, so that an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Patterns that clean text must not hold.
LEAKS = {"tag": "<[^>]+>", "entity": "&[a-zA-Z]+;|&#[0-9]+;", "marker": r"\\[a-z]+", "brace": r"\{\{|\}\}"}


def reconcile(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count of each stage beside the first one's."""
    counted = None
    for name, df in stages.items():
        one = df.agg(F.lit(name).alias("stage"), F.count("*").alias("n"))
        counted = one if counted is None else counted.unionByName(one)
    return counted


def leaks(df: DataFrame, text: str, patterns: dict[str, str] = LEAKS) -> DataFrame:
    """How many texts hold each pattern: one pass."""
    row = df.agg(*(F.count_if(F.col(text).rlike(p)).alias(k) for k, p in patterns.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), F.col(k).alias("n")) for k in patterns))).alias("x")).select("x.*")


def out_of_order(df: DataFrame, name: str, place: str, wanted: list[str]) -> DataFrame:
    """Names whose place in the data is not the one wanted."""
    seen = df.select(name, place).distinct()
    at = F.array_position(F.lit(wanted), F.col(name)) - 1
    return seen.where(~at.eqNullSafe(F.col(place).cast("long")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def neighbours(df: DataFrame, missing: DataFrame, group: list[str], at: str, reach: int = 1) -> DataFrame:
    """Rows near each missing key of a group, by an equality on place after unfolding the reach."""
    near = missing.select(*group, F.col(at).alias("missing"), F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias(at))
    return near.join(df, [*group, at])


def coverage(df: DataFrame, unit: list[str]) -> DataFrame:
    return df.groupBy(*unit).agg(F.count("*").alias("n"))


def starts_within(raw: DataFrame, stored: DataFrame, key: str, raw_text: str, text: str, chars: int = 40) -> DataFrame:
    """Keys whose stored text does not begin anywhere in the raw one."""
    met = stored.join(raw, key)
    return met.where(~F.contains(raw_text, F.substring(text, 1, chars))).select(key)


def untraced(rows: DataFrame, source: str, listed: DataFrame) -> DataFrame:
    """Sources in use that the list lacks."""
    return rows.select(source).distinct().join(listed, source, "left_anti")


def unresolved(parsed: DataFrame) -> DataFrame:
    """References that could not be read or do not exist, with their error."""
    return parsed.where("error is not null")


def gaps(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Ranges of values that a group lacks between its least and greatest."""
    w = Window.partitionBy(*group).orderBy(value)
    following = df.select(*group, value).distinct().withColumn("next", F.lead(value).over(w))
    return following.where(F.col("next") > F.col(value) + 1).select(*group, (F.col(value) + 1).alias("low"), (F.col("next") - 1).alias("high"))
