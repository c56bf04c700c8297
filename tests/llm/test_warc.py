import gzip
import hashlib
import io

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from stanzaline.llm import warc as A

BIG = "<p>é</p>" * 200
ROWS = [(1, "http://a", BIG), (5, "http://b", BIG), (3, None, BIG), (5, "http://b", BIG), (2, "u", "small"), (4, "u", "small"), (6, "u\r\nX: 1", None), (7, "", ""), (None, "n", BIG), (None, None, None), (8, "long", "x" * 3_000_000), (9, "w", "\r\n\r\nWARC/1.1\r\n" * 100)]
SCHEMA = "page_id long, url string, html string"


def wanted(rows):
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= A.MIN_REVISIT:
            top[h] = max(i, top.get(h, i))
    counts = {}
    for _, _, h in rows:
        counts[h] = counts.get(h, 0) + 1
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = top.get(h) if counts[h] > 1 and top.get(h) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def found(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for df in (pages, pages.select("*", *(F.lit(1).alias(c) for c in ("d", "salt", "top", "n", "refers_to")))):
        archives = A.write_archives(df, archive_bytes=2000)
        assert sum(n for _, n, _ in archives) == len(ROWS)
        records = A.read_archives(spark, [p for p, _, _ in archives])
        assert found(records) == wanted(ROWS)
        payloads = {(r.page_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect()}
        assert payloads == {(i, (h or "").encode()) for i, _, h in ROWS if (i, h) not in {(1, BIG), (3, BIG), (None, BIG)}}


def test_other_readers_can_read_it(spark):
    archives = A.write_archives(spark.createDataFrame(ROWS[:3], SCHEMA))
    for path, n, size in archives:
        store, at = fs.FileSystem.from_uri(path)
        data = store.open_input_stream(at, compression=None).read()
        assert len(data) == size and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == n


def test_empty(spark):
    assert A.write_archives(spark.createDataFrame([], SCHEMA)) == []
    assert A.read_archives(spark, []).count() == 0


def test_damage_is_noticed():
    raw = A._record("response", 1, "u", b"x" * 50, None)
    (one,) = A.members(io.BytesIO(raw))
    assert A._page(one, "a")[:3] == (1, "u", 50)
    with pytest.raises(ValueError):
        A.parse_record(one.replace(b"xxx", b"xyx", 1))
    with pytest.raises(ValueError):
        A.parse_record(one[:-3])
    with pytest.raises(ValueError):
        list(A.members(io.BytesIO(raw[:-12])))
    with pytest.raises(ValueError):
        A.parse_record(b"junk")


def test_members_in_small_reads(monkeypatch):
    raw = b"".join(A._record("response", k, "u", bytes([k]) * (k * 700), None) for k in range(8))
    monkeypatch.setattr(A, "READ_BYTES", 7)
    assert [A._page(m, "a")[0] for m in A.members(io.BytesIO(raw))] == list(range(8))


def test_archives_are_cleared(spark):
    from stanzaline.llm import common

    pages = spark.createDataFrame([(1, "http://a", "x" * 2000)], "page_id long, url string, html string")
    ((path, records, _),) = A.write_archives(pages)
    folder = path.rpartition("/")[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    assert records == 1 and fs.exists(at)
    common.clear(spark)
    assert not fs.exists(at)
