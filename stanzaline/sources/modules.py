"""Compressed text modules as a Spark data source: ``spark.read.format("text_module")``.

A module is a pair of files: an index of records of one size, and the data that they point into. A partition is a
run of index records of one module, and reads its own slice of both files, so a module of any size is read by
many tasks and no task holds a file. Filters on module and block are pushed to the planning of partitions: other
modules and runs are not read.

Kinds of modules: ``blocks`` (offset, size, full size of zlib blocks of text), ``entries`` (offset, size of zlib
blocks, each a count, then offset and size of its entries), ``keys`` (offset, size of records, a term, a line end and
the numbers of a block and an entry).

Defined cases: blocks of size 0 are empty and give no row, as entries at offset 0 give an empty text; bytes that are
no UTF-8 become replacement signs; a folder without modules has no rows; a module without data is an error; files
of other endings are left alone.
"""

from __future__ import annotations

import html
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

from ..functions import text as T

#: Index records of one partition.
RUN = 4096


@dataclass(frozen=True)
class Kind:
    """Bytes of an index record, endings of the two files, and the columns of the rows."""

    record: int
    index: str
    data: str
    schema: str


KINDS = {
    "blocks": Kind(12, ".idx", ".dat", "module string, block int, body string"),
    "entries": Kind(8, ".zdx", ".zdt", "module string, block int, entry int, text string"),
    "keys": Kind(8, ".idx", ".dat", "module string, nth int, term string, block int, entry int"),
}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else "file://" + path)


@dataclass
class Run(InputPartition):
    """Records ``first`` to ``last`` (exclusive) of a module's index."""

    module: str
    index: str
    data: str
    first: int
    last: int


class ModuleReader(DataSourceReader):
    def __init__(self, kind: str, path: str, run: int):
        self.kind, self.path, self.run = kind, path, run
        self.modules: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Modules and, where a record is a block, ranges of blocks; Spark checks the latter again."""
        numbered = "block" if self.kind != "keys" else "nth"
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column == "module" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.modules = own if self.modules is None else self.modules & own
                continue
            if column == numbered and isinstance(f, (EqualTo, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
            if column == numbered and isinstance(f, (EqualTo, LessThanOrEqual)):
                self.high = f.value + 1 if self.high is None else min(self.high, f.value + 1)
            yield f

    def partitions(self) -> list[Run]:
        kind = KINDS[self.kind]
        store, folder = _open(self.path)
        files = {i.base_name: i for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file}
        runs = []
        for name in sorted(n for n in files if n.endswith(kind.index)):
            stem = name.removesuffix(kind.index)
            module = unquote(stem)
            if self.modules is not None and module not in self.modules:
                continue
            if stem + kind.data not in files:
                raise FileNotFoundError(f"{self.path}/{stem}{kind.data}")
            count = files[name].size // kind.record
            end = count if self.high is None else min(count, self.high)
            for first in range(self.low, end, self.run):
                runs.append(Run(module, files[name].path, files[stem + kind.data].path, first, min(end, first + self.run)))
        return runs or [Run("", "", "", 0, 0)]

    def read(self, part: Run) -> Iterator[tuple]:
        if part.first >= part.last:
            return
        store, record = _open(self.path)[0], KINDS[self.kind].record
        with store.open_input_file(part.index) as source:
            index = source.read_at((part.last - part.first) * record, part.first * record)
        places = [p[:2] for p in struct.iter_unpack("<" + "I" * (record // 4), index)]
        with store.open_input_file(part.data) as source:
            for at, (start, size) in enumerate(places, part.first):
                yield from _ROWS[self.kind](part.module, at, source.read_at(size, start))


def _block_rows(module: str, at: int, data: bytes) -> Iterator[tuple]:
    if data:
        yield module, at, zlib.decompress(data).decode("utf-8", "replace")


def _entry_rows(module: str, at: int, data: bytes) -> Iterator[tuple]:
    if not data:
        return
    body = zlib.decompress(data)
    (count,) = struct.unpack_from("<I", body)
    for n, (start, size) in enumerate(struct.iter_unpack("<II", body[4 : 4 + 8 * count])):
        yield module, at, n, body[start : start + size].decode("utf-8", "replace").rstrip("\0") if start else ""


def _key_rows(module: str, at: int, data: bytes) -> Iterator[tuple]:
    # the numbers may hold a line end themselves
    if len(data) >= 10 and data[-10:-8] == b"\r\n":
        yield module, at, html.unescape(data[:-10].decode("utf-8", "replace")).strip(), *struct.unpack("<II", data[-8:])


_ROWS = {"blocks": _block_rows, "entries": _entry_rows, "keys": _key_rows}


class ModuleSource(DataSource):
    """Options: ``kind`` of KINDS, ``path`` of a folder, ``run`` (records of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "text_module"

    def schema(self) -> str:
        return KINDS[self.options["kind"]].schema

    def reader(self, schema) -> ModuleReader:
        return ModuleReader(self.options["kind"], self.options["path"], int(self.options.get("run", RUN)))


def read(spark: SparkSession, path: str, kind: str, run: int = RUN) -> DataFrame:
    """The rows of all modules of a kind in a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ModuleSource)
    return spark.read.format("text_module").option("kind", kind).option("run", run).load(path)


def write(files: DataFrame, path: str, kind: str) -> int:
    """Write (module, index, data) rows as files of a kind; how many modules. A module's files get their names when they are whole.

    With a column ``piece`` a module comes in pieces, each with an index of its own data, which are written one after
    the other by their numbers; no task holds a module.
    """
    ends, width = (KINDS[kind].index, KINDS[kind].data), KINDS[kind].record // 4

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        open_, drafts, outs, base = None, (), (), 0

        def done() -> pa.RecordBatch:
            for draft, out, end in zip(drafts, outs, ends):
                out.close()
                store.move(draft, f"{folder}/{quote(open_, safe='')}{end}")
            return pa.RecordBatch.from_arrays([pa.array([open_], pa.string())], names=["module"])

        for batch in batches:
            for at, module in enumerate(batch.column(0).to_pylist()):
                if outs and (module != open_ or not pieces):
                    yield done()
                    outs = ()
                if not outs:
                    open_, base = module, 0
                    drafts = [f"{folder}/.{uuid.uuid4().hex}" for _ in ends]
                    outs = [store.open_output_stream(d) for d in drafts]
                index, data = (batch.column(k)[at].as_buffer() for k in (1, 2))
                if base:
                    if base + data.size >> 32:
                        raise OverflowError(f"{module} is larger than an index of this kind can say")
                    index = np.frombuffer(index, "<u4").reshape(-1, width) + np.array([base] + [0] * (width - 1), "<u4")
                    index = pa.py_buffer(np.ascontiguousarray(index))
                for out, body in zip(outs, (index, data)):
                    out.write(body)
                base += data.size
        if outs:
            yield done()

    # a write is an action, so each module is written by one task that Spark may run again
    pieces = "piece" in files.columns
    rows = files.repartition("module").sortWithinPartitions("module", "piece") if pieces else files
    return rows.select("module", "index", "data").mapInArrow(put, "module string").count()


def keyed_entries(keys: DataFrame, entries: DataFrame, heading: str = r'^<entryFree n="((?:[^"\\]|\\.)*)"') -> tuple[DataFrame, DataFrame]:
    """Entries of a dictionary in the order of its key index, with the term that the entry itself has, and what does not fit.

    Keys meet entries on (module, block, entry). Faults are keys without an entry, entries without a key, and
    keys whose entry has another term, in any letter case.
    """
    place = ["module", "block", "entry"]
    own = F.trim(T.unescape_common(F.regexp_extract("text", heading, 1)))
    met = keys.join(entries.withColumn("own", own), place, "full")
    fault = F.when(F.col("text").isNull(), "no entry").when(F.col("term").isNull(), "no key").when(F.upper("term") != F.upper("own"), "other term")
    met = met.withColumn("fault", fault)
    return met.where("fault is null").select("module", "nth", F.col("own").alias("term"), "text"), met.where("fault is not null").select(*place, "fault")
