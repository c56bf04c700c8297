"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one word: anything but a blank and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of Parquet that one bucket of a hash-partitioned Python step is meant to hold.
BUCKET_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where nothing is set and the master is local (tests, a laptop) a temporary folder is made and set;
    a cluster without the setting is an error, since its machines share no folder that could be guessed.
    """
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if named := spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    else:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stanzaline-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that this process wrote to the shared folder and has not cleared.
_written: list[str] = []


def owned_path(spark: SparkSession, name: str) -> str:
    """A fresh path that ``clear`` removes."""
    _written.append(fresh_path(spark, name))
    return _written[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it again. ``clear`` removes it."""
    spark = df.sparkSession
    path = owned_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Remove the tables that ``materialize`` wrote, but for those that ``keep`` reads. For owners whose frames are all read."""
    kept = set() if keep is None else {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()}
    for path in [p for p in _written if p.rpartition("/")[2] not in kept]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def buckets(df: DataFrame, each: int = BUCKET_BYTES) -> int:
    """How many buckets the input needs, from the size that the scan reports; never under the shuffle setting's eighth."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known > 1 << 60:  # a source that reports no size
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, -(-known // each))


#: At most so many keys are dealt to several tasks by ``spread_join``; the list of them is broadcast.
HOT_KEYS = 20_000
#: Rows of one key that stay in one task, at least.
KEY_ROWS = 1_000


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str, n: str = "n") -> DataFrame:
    """Inner join of ``many`` with ``few``, which has one row for each key and its rows in ``many`` as the column that ``n`` names.

    Keys with more rows than KEY_ROWS, and more than the HOT_KEYS-th part of all, are dealt by a hash of column
    ``by`` to several tasks. As the counts add up to no more than all rows, there are at most HOT_KEYS of them,
    so their list can be broadcast at any size of the input.
    """
    total = few.agg(F.sum(n)).first()[0] or 0
    each = max(KEY_ROWS, -(-total // HOT_KEYS))
    hot_key, hot_salts, hot_salt = fresh([*many.columns, *few.columns], "hot_key", "hot_salts", "hot_salt")
    salts = F.ceil(F.col(n) / F.lit(each)).cast("int")
    hot = few.where(F.col(n) > each).select(F.col(key).alias(hot_key), salts.alias(hot_salts))
    dealt = many.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")
    dealt = dealt.withColumn(hot_salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(hot_salts)), F.lit(0)).cast("int")).drop(hot_key, hot_salts)
    copied = few.withColumn(hot_salt, F.explode(F.when(F.col(n) > each, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [key, hot_salt]).drop(hot_salt)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes to differ from all columns (in any letter case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that only a part's texts are Python objects at a time.

    When they are through, what the worker has freed goes back to the machine: workers stay for the stages after theirs.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Give freed memory back to the machine, of Arrow's pool and, with the GNU library, of all else."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def word_count(text):
    """Words of a text as a long; null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
