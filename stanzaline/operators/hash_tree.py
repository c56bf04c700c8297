"""Comparison of two tables by trees of hashes: what is equal is neither shuffled nor joined.

Rows fall into leaves by a hash of their key. A leaf holds how many rows it has and sums of their hashes, in any
order, combined before the shuffle; a node above holds the sums of its sixteen children. Two trees are compared
from the root down, only below nodes that differ; then the rows of the differing leaves alone are joined.

``store`` writes a table by leaf together with its tree, so that a comparison of stored tables reads the
trees and the files of differing leaves, and of equal tables one row each.

Defined cases: rows are compared as multisets of their key and value columns, null-safe; repeated rows count; null keys are
keys; an empty table has a tree without nodes; NaN equals NaN, and zero equals minus zero; columns of maps have no hash and
raise. A leaf has the sums of two 64-bit hashes, so a difference passes unseen with a chance of about 2^-120.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels below the root; each node has 16 children, so there are 65,536 leaves and their list can be broadcast.
DEPTH, FAN = 4, 16
#: Level whose nodes are the folders of a stored table: 256; 1 for small tables.
FOLDERS = 2
#: Bytes of input for one file of a stored table.
FILE_BYTES = 128 << 20
_SUMS = ("n", "h0", "h1")


def _plain(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns in which equal values have equal hashes: zeros without a sign, NaN as one value."""
    kinds = dict(df.dtypes)
    return [F.when(F.isnan(c), F.lit("NaN").cast(kinds[c])).otherwise(F.col(c) + F.lit(0).cast(kinds[c])) if kinds[c] in ("double", "float") else F.col(c) for c in names]


def leaf_of(df: DataFrame, keys: list[str], depth: int = DEPTH) -> Column:
    """Number of a row's leaf. A null hashes like a column left out, so each column's absence is hashed too."""
    cols = _plain(df, keys)
    return F.pmod(F.xxhash64(*cols, *(c.isNull() for c in cols)), F.lit(FAN**depth)).cast("int")


def _row_hashes(df: DataFrame, columns: list[str]) -> list[Column]:
    cols = _plain(df, columns)
    parts = [*cols, *(c.isNull() for c in cols)]
    # as decimals, whose sums over a hot leaf do not overflow below 10^13 rows
    return [h.cast("decimal(22,0)") for h in (F.xxhash64(F.lit(1), *parts), F.xxhash64(*parts, F.lit(2)))]


def leaves(df: DataFrame, keys: list[str], columns: list[str], depth: int = DEPTH) -> DataFrame:
    """(node, n, h0, h1) of each leaf that has rows: one aggregate over the table."""
    own = df.select(leaf_of(df, keys, depth).alias("node"), *(h.alias(f"h{i}") for i, h in enumerate(_row_hashes(df, columns))))
    return own.groupBy("node").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in _SUMS[1:]))


def tree(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, n, h0, h1) of leaves and of all nodes above; the root is level 0."""
    up = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("node") / FAN ** (depth - k)).cast("int").alias("above")) for k in range(depth + 1))))
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _SUMS]
    return found.withColumn("up", up).groupBy(F.col("up.level").alias("level"), F.col("up.above").alias("node")).agg(*wide)


def differing(a: DataFrame, b: DataFrame, level: int, within: list[int] | None = None) -> list[int]:
    """Nodes of a level, below the given ones of the level above, that are not equal in two trees; 16^level at most."""
    at = lambda t: t.where(F.col("level") == level) if within is None else t.where((F.col("level") == level) & F.floor(F.col("node") / FAN).cast("int").isin(within))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _SUMS]
    unlike = ~same[0]
    for s in same[1:]:
        unlike |= ~s
    met = at(a).alias("a").join(at(b).alias("b"), F.col("a.node") == F.col("b.node"), "full").where(unlike)
    return sorted(r[0] for r in met.select(F.coalesce("a.node", "b.node")).collect())


def descend(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> list[int]:
    """The leaves in which two trees differ, found from the root down; none after one look if the roots are equal."""
    found: list[int] | None = None
    for level in range(depth + 1):
        found = differing(a, b, level, found)
        if not found:
            return []
    return found or []


def _unequal_leaves(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(node): the leaves in which two tables differ, at most 16^DEPTH; one aggregate over each table."""
    sums = [leaves(df, keys, columns).select("node", F.struct(*_SUMS).alias("sums")) for df in (a, b)]
    met = sums[0].alias("a").join(sums[1].alias("b"), "node", "full")
    return met.where(~F.col("a.sums").eqNullSafe(F.col("b.sums"))).select("node")


def unequal_rows(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that are in leaves in which they differ; all differences are among them."""
    nodes = F.broadcast(_unequal_leaves(a, b, keys, columns))
    return tuple(df.join(nodes, leaf_of(df, keys) == F.col("node"), "left_semi") for df in (a, b))


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with rows that the other side lacks, as (keys, kind): 'only left', 'only right', 'differs'; each key once."""
    left, right = unequal_rows(a, b, keys, [*keys, *values])
    return _kinds(left, right, keys, values)


def _kinds(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    side = lambda df, name: df.select(*(c.alias(f"k{i}") for i, c in enumerate(_plain(df, keys))), F.lit(name).alias("side"), *(c.alias(f"v{i}") for i, c in enumerate(_plain(df, values))))
    names, own = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]
    rows = side(left, 1).unionByName(side(right, -1))
    # a row that one side has more often than the other leaves a count that is not zero
    per = rows.groupBy(*names, *own).agg(F.sum("side").alias("more"), F.max("side").alias("top"), F.min("side").alias("least"))
    met = per.groupBy(*names).agg(F.max("top").alias("top"), F.min("least").alias("least"), F.count_if(F.col("more") != 0).alias("off")).where("off > 0")
    kind = F.when(F.col("least") == 1, "only left").when(F.col("top") == -1, "only right").otherwise("differs")
    return met.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), kind.alias("kind"))


def store(df: DataFrame, keys: list[str], path: str, folders: int = FOLDERS) -> None:
    """Write a table in a folder for each node of a level, and its tree beside them.

    A folder is written by one task for each FILE_BYTES that it is expected to hold; rows are dealt by a hash of all of
    their columns, so that a key with many rows is not one task's.
    """
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = 1 if known > 1 << 60 else -(-known // (FILE_BYTES * FAN**folders)) or 1
    rows = df.withColumn("_leaf", leaf_of(df, keys)).withColumn("_node", F.floor(F.col("_leaf") / FAN ** (DEPTH - folders)).cast("int"))
    rows = rows.repartition("_node", F.pmod(F.xxhash64(*df.columns), F.lit(tasks)))
    rows.sortWithinPartitions("_node", "_leaf").write.partitionBy("_node").parquet(f"{path}/rows")
    tree(leaves(df, keys, df.columns)).coalesce(1).sortWithinPartitions("level", "node").write.partitionBy("level").parquet(f"{path}/tree")


class Stored:
    """A table that ``store`` wrote."""

    def __init__(self, spark: SparkSession, path: str, schema: str, folders: int = FOLDERS):
        """``schema`` is that of the rows, for tables that have none; ``folders`` as it was stored."""
        self.spark, self.path, self.schema, self.folders = spark, path, schema, folders

    def tree(self) -> DataFrame:
        return self.spark.read.schema("node int, level int, " + ", ".join(f"{c} decimal(38,0)" for c in _SUMS)).parquet(f"{self.path}/tree")

    def rows(self, found: list[int] | None = None) -> DataFrame:
        """All rows, or those of some leaves: folders are pruned, row groups skipped by the leaf's number."""
        if found == []:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, _leaf int, _node int").parquet(f"{self.path}/rows")
        if found is not None:
            nodes = sorted({n // FAN ** (DEPTH - self.folders) for n in found})
            rows = rows.where(F.col("_node").isin(nodes)) if len(nodes) < FAN**self.folders else rows
            listed = self.spark.createDataFrame([(n,) for n in found], "_leaf int")
            rows = rows.join(F.broadcast(listed), "_leaf", "left_semi")
        return rows.drop("_leaf", "_node")


def stored_differences(a: Stored, b: Stored, keys: list[str], values: list[str]) -> DataFrame:
    """``differences`` of stored tables."""
    found = descend(a.tree(), b.tree())
    return _kinds(a.rows(found), b.rows(found), keys, values)


def left_only(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks; the set difference, of differing leaves alone."""
    left, right = unequal_rows(a, b.toDF(*a.columns), a.columns, a.columns)
    return left.distinct().exceptAll(right.distinct())
