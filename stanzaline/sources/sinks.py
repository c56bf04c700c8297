"""Writers: append and JSON reports; ``versions`` has those that replace rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def open_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store's rows, none where nothing has been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
