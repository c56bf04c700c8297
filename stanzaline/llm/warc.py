"""WARC archives: one gzip member per record, and a sequential reader.

``write_archives`` writes every page as a record; ``read_archives`` reads archives record by record
with incremental decompression, frames each block by its content length and verifies its digest.

Defined cases: a null html is an empty payload; a null url is an empty target; a null page_id is
written as such, is never the page that others refer to, and refers to the largest known page_id of
its payload, if any. Repeated rows give repeated records. Pages that tie on the largest page_id of
a payload are all responses. An empty table gives no archives and no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads shorter than this never become revisits.
MIN_REVISIT = 1000
#: Compressed bytes after which a writer starts the next archive.
ARCHIVE_BYTES = 256 << 20
#: A hot payload's pages are dealt to so many partitions.
SALTS = 64
READ_BYTES = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string"


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    tail = record_id.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def _record(kind: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    digest = hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    target = "".join(c for c in url if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _opened(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url)


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        out, name, size, count, done = None, "", 0, 0, []

        def close():
            # a name appears only when its archive is whole; an attempt that dies leaves none that is listed
            out.close()
            store.move(f"{base}/.{name}", f"{base}/{name}")
            done.append((f"{folder}/{name}", count, size))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, html, refers_to = row
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/.{name}", compression=None)
                member = _record("response" if refers_to is None else "revisit", page_id, url or "", (html or "").encode("utf-8", "replace"), refers_to)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*done)))))

    return write


def referred(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The pages with ``refers_to``: for revisits the page whose payload they repeat, else null.

    One shuffle of the pages, keyed by payload digest and a salt, so that no payload's pages meet in
    one task; the other side has a row for each repeated payload and salt.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(html, 256).alias("d"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt"))
    long_ones = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit)
    repeated = long_ones.groupBy("d").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    repeated = repeated.select("d", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    joined = pages.join(repeated, ["d", "salt"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("top").eqNullSafe(F.col("page_id")), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> list[tuple[str, int, int]]:
    """Write the pages (page_id, url, html) as archives; (path, records, bytes) of each.

    The list has one entry per archive, so it grows with the bytes written over ``archive_bytes``.
    Only archives of successful task attempts are in it. Without a folder they go to one that ``common.clear`` removes.
    A record is held whole while it is written or read, so a payload must fit into a task's memory.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = common.owned_path(spark, "warc")
    store, base = _opened(folder)
    store.create_dir(base, recursive=True)
    rows = referred(pages, min_revisit).mapInArrow(_writer(folder, archive_bytes), "path string, records long, bytes long").collect()
    return [tuple(r) for r in sorted(rows)]


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time, read in pieces of bounded size."""
    unzip, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(READ_BYTES)
        if not data:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(unzip.decompress(data))
        rest = b""
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts, rest = zlib.decompressobj(31), [], unzip.unused_data


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record, framed by its content length and verified."""
    head, split, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not split or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("a record's content length is wrong")
    if (want := fields.get("warc-block-digest")) and want != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ValueError("a record's block digest is wrong")
    return fields, block


def _page(raw: bytes, archive: str) -> tuple:
    fields, block = parse_record(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    size = int(stated[b"content-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a record's payload differs from its length or digest")
    refers = _page_id(fields["warc-refers-to"]) if kind == "revisit" else None
    return _page_id(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind, refers, payload if kind == "response" else None, archive


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("archive", pa.string())])


def _reader(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _opened(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for raw in members(stream):
                        row = _page(raw, path)
                        rows.append(row if keep_payload else (*row[:6], None, path))
                        held += len(raw) * keep_payload + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return run


def read_archives(spark: SparkSession, archives: list[str], keep_payload: bool = True) -> DataFrame:
    """Every record of the archives, one task per archive, read from its start to its end."""
    if not archives:
        return spark.createDataFrame([], RECORD_SCHEMA)
    paths = spark.createDataFrame([(p,) for p in archives], "path string").repartition(len(archives))
    return paths.mapInArrow(_reader(keep_payload), RECORD_SCHEMA)
