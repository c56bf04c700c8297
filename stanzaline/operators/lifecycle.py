"""Upserts, patches and replacements as pure functions; writing is the caller's last step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_or_ignore(kept: DataFrame, fresh: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """``kept`` and the first row of each new key of ``fresh`` in the order of ``tie``."""
    w = Window.partitionBy(*keys).orderBy(*tie)
    first = fresh.join(kept.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.unionByName(first)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``changes`` in place where its key is known and its value is not null."""
    names = [c for c in changes.columns if c != key]
    met = rows.join(changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names)), key, "left")
    return met.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def unmet(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys of ``expected`` whose row is absent or differs in one of its columns."""
    names = [c for c in expected.columns if c != key]
    met = expected.join(rows.select(key, *(F.col(c).alias(f"_is_{c}") for c in names), F.lit(1).alias("_there")), key, "left")
    same = F.col("_there").isNotNull()
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"_is_{c}"))
    return met.where(~same).select(key)


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value is another one after a change."""
    met = before.select(key, F.col(value).alias("_before")).join(after.select(key, F.col(value).alias("_after")), key, "full")
    return met.where(~F.col("_before").eqNullSafe(F.col("_after"))).select(key)


def copy_table(spark: SparkSession, name: str, to: str, rename: dict[str, str] | None = None) -> DataFrame:
    rows = spark.table(name).withColumnsRenamed(rename or {})
    rows.write.saveAsTable(to)
    return spark.table(to)
