"""Folders that the driver and all executors share, and files in them by Spark's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master without that setting gets a temporary one."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if named := spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    else:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stanzaline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Folders that this process made and has not cleared.
_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Remove the folders that ``fresh_folder`` named. For owners whose frames are all read."""
    while _made:
        remove(spark, _made.pop())


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet; False if it is, so that of several writers one succeeds."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    # a rename shows the file as a whole or not at all
    done = not fs.exists(at) and fs.rename(draft, at)
    if not done:
        fs.delete(draft, False)
    return bool(done)


def content(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    source = fs.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def state_of(spark: SparkSession, files: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of files: what tells one state of a table from another."""
    out = []
    for path in sorted(files):
        fs, at = _at(spark, path)
        status = fs.getFileStatus(at)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out
