"""Tables in versions: a write becomes visible as a whole, by a manifest, or not at all.

A version is a manifest file that names the folders of its rows, by partition value where the table has a
partition column. Rows are written first; the version exists when its manifest does. Two writers that start
from one version cannot both commit, since a manifest of a number is created once. A draft that is not
committed is the dry run of a change: it can be read like a version, and the table does not change.

Defined cases: a table that was never committed has no rows; a null partition value is one like any other;
a draft without rows leaves the replaced partitions empty; versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import places

#: Partition values that one write may replace: their names are listed by the driver and in the manifest.
MOST_PARTITIONS = 100_000
_ALL = ""


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Version:
    """A number from 1 on, the schema, and the folders of the rows: by partition value as JSON text, or under one name."""

    number: int
    schema: str
    folders: dict[str, list[str]]


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        return [int(n.removesuffix(".json")) for n in places.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version | None:
        """A version, by default the last; None if there is none."""
        number = max(self.numbers(), default=0) if number is None else number
        return Version(number, **json.loads(places.content(self.spark, f"{self.path}/versions/{number:010d}.json"))) if number else None

    def read(self, number: int | None = None, schema: str | None = None) -> DataFrame:
        """The rows of a version, by default of the last; ``schema`` is for a table that has none yet."""
        found = self.version(number)
        if found is None:
            if schema is None:
                raise ValueError(f"{self.path} has no version yet")
            return self.spark.createDataFrame([], schema)
        return self._rows(found)

    def _rows(self, version: Version) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema))
        folders = [f for own in version.folders.values() for f in own]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/rows/{f}" for f in folders))

    def append(self, rows: DataFrame) -> Draft:
        """A draft with the rows added."""
        before = self.version()
        folders = {k: list(v) for k, v in before.folders.items()} if before else {}
        for value, own in self._written(rows).items():
            folders[value] = [*folders.get(value, []), *own]
        return self._draft(before, rows, folders)

    def replace(self, rows: DataFrame) -> Draft:
        """A draft of which the rows are all."""
        return self._draft(self.version(), rows, self._written(rows))

    def replace_partitions(self, rows: DataFrame, values: list | None = None) -> Draft:
        """A draft with the rows in place of the partitions that they belong to, and of those named by ``values``."""
        if self.partition is None:
            raise ValueError("the table has no partition column")
        before, written = self.version(), self._written(rows)
        gone = {json.dumps(v) for v in values or []}
        kept = {k: v for k, v in before.folders.items() if k not in gone} if before else {}
        return self._draft(before, rows, {**kept, **written})

    def _draft(self, before: Version | None, rows: DataFrame, folders: dict[str, list[str]]) -> Draft:
        schema = json.dumps(StructType([f for f in rows.schema]).jsonValue()) if before is None else before.schema
        if before is not None and [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in StructType.fromJson(json.loads(schema))]:
            raise ValueError("the rows have other columns than the table")
        return Draft(self, before.number if before else 0, Version((before.number if before else 0) + 1, schema, folders))

    def _written(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows to new folders; their names by partition value."""
        name = uuid.uuid4().hex
        if self.partition is None:
            rows.write.parquet(f"{self.path}/rows/{name}")
            return {_ALL: [name]}
        # the value stands in the rows too, so that a folder can be read by itself
        rows.withColumn("_part", F.xxhash64(self.partition)).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/rows/{name}")
        there = self.spark.read.parquet(f"{self.path}/rows/{name}") if places.names(self.spark, f"{self.path}/rows/{name}")[1:] else rows.limit(0).withColumn("_part", F.lit(0))
        found = there.select("_part", F.col(self.partition).alias("value")).distinct().limit(MOST_PARTITIONS + 1).collect()
        if len(found) > MOST_PARTITIONS:
            raise ValueError(f"more than {MOST_PARTITIONS} partitions in one write")
        out: dict[str, list[str]] = {}
        for r in found:
            out.setdefault(json.dumps(r["value"], default=str), []).append(f"{name}/_part={r['_part']}")
        if len(set(sum(out.values(), []))) < len(found):
            raise ValueError("two partition values share a hash")
        return out

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the last ``keep`` versions, and rows of none of these. For when no draft is open."""
        numbers = self.numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        used = {f for v in kept for own in v.folders.values() for f in own}
        for n in numbers[:-keep]:
            places.remove(self.spark, f"{self.path}/versions/{n:010d}.json")
        for name in places.names(self.spark, f"{self.path}/rows"):
            inner = [f"{name}/{x}" for x in places.names(self.spark, f"{self.path}/rows/{name}") if x.startswith("_part=")]
            if name not in used and not used & set(inner):
                places.remove(self.spark, f"{self.path}/rows/{name}")
            else:
                for x in set(inner) - used if inner else ():
                    places.remove(self.spark, f"{self.path}/rows/{x}")


@dataclass(frozen=True)
class Draft:
    """A change that is written but not part of the table yet."""

    table: VersionedTable
    parent: int
    version: Version

    def read(self) -> DataFrame:
        """The table as it would be."""
        return self.table._rows(self.version)

    def commit(self) -> int:
        """Make it the next version; Conflict if another one was committed since it was begun."""
        text = json.dumps({"schema": self.version.schema, "folders": self.version.folders})
        if max(self.table.numbers(), default=0) != self.parent or not places.create(self.table.spark, f"{self.table.path}/versions/{self.version.number:010d}.json", text):
            raise Conflict(f"version {self.version.number} of {self.table.path} is there already")
        return self.version.number
