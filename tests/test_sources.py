"""Readers on small files of each format."""

import hashlib
import json
import struct
import zlib

import pytest

from stanzaline.sources import modules as M
from stanzaline.sources import readers as R
from stanzaline.sources import sinks


def rows(df, *by):
    return sorted(tuple(r) for r in df.select(*(by or df.columns)).collect())


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)
    return str(path)


def test_json_shapes(spark, tmp_path):
    a = put(tmp_path, "a.json", json.dumps({"book": "Ruth", "chapters": {"1": {"1": "x", "2": "y"}}}))
    assert rows(R.json_chapter_maps(R.whole_texts(spark, a))) == [("Ruth", 1, 1, "x"), ("Ruth", 1, 2, "y")]
    b = put(tmp_path, "b.json", json.dumps({"books": [{"name": "Ruth", "chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "x"}]}]}]}))
    assert rows(R.json_nested(R.whole_texts(spark, b))) == [("Ruth", 1, 1, "x")]
    c = put(tmp_path, "c.json", json.dumps({"moods": [{"mood": "calm", "label": "Calm"}]}))
    assert rows(R.json_config(spark, c, "moods"), "mood", "label") == [("calm", "Calm")]
    assert rows(R.config_entries(R.whole_texts(spark, c), "moods", "mood string, label string")) == [("calm", "Calm")]


USFM = "\\id RUT notes\n\\c 1\n\\p\n\\v 1 In the \\nd days\\nd*|\nof old \\f + \\ft gone\\f*\n\\v 2\n\\c 2\n\\v 1 And so\n"


def test_markers(spark, tmp_path):
    texts = R.whole_texts(spark, put(tmp_path, "a.usfm", USFM))
    whole = [r for r in rows(R.markers_whole(texts)) if r[3]]
    assert whole == [("RUT", 1, 1, "In the days of old"), ("RUT", 2, 1, "And so")]
    by_line = rows(R.markers_by_line(R.whole_texts(spark, put(tmp_path, "b.usfm", USFM.replace("\\f + \\ft gone\\f*", "")))))
    assert by_line == whole


def test_tagged_and_segments(spark, tmp_path):
    texts = R.whole_texts(spark, put(tmp_path, "a.xml", '<v id="1" bcv="RUT.1.1"/>In <w>the</w> days<f>n</f> &amp; so<ve/> <v id="2" bcv="RUT.1.2"/><f>x</f><ve/>'))
    assert rows(R.tagged_verses(texts)) == [("RUT", 1, 1, "In the days & so")]
    walk = R.whole_texts(spark, put(tmp_path, "b.xml", '<book id="RUT"><c id="1"/><v id="1"/>In <q>the <f>no</f>days</q><v id="2"/>of<p/> old</book>'))
    assert rows(R.segment_walk(walk)) == [("RUT", 1, 1, "In the days"), ("RUT", 1, 2, "of old")]


def test_marked_verse_lines(spark, tmp_path):
    body = "\ufeff\\id RUT x\n\\h Ruth\n\\c 1\n\\p\n\\v 1 In the\n\\q skipped\n  days \\nd of\\nd* old\n\n\\v 2-3 so\n\\c 2\nnowhere\n\\v 1\n\\v 2 end"
    put(tmp_path, "a.p.sfm", body)
    put(tmp_path, "b.p.sfm", "\\id FRT\n\\c 1\n\\v 1 no")
    texts = R.whole_texts(spark, str(tmp_path / "*.sfm"))
    assert rows(R.marked_verse_lines(texts, ["RUT"])) == [("RUT", 1, "1", "In the days of old"), ("RUT", 1, "2-3", "so"), ("RUT", 2, "2", "end")]


def test_odd_numbers_and_escapes(spark, tmp_path):
    walk = R.whole_texts(spark, put(tmp_path, "b.xml", '<book id="RUT"><c id="x"/><v id="1"/>lost<c id="1"/><v id="a"/>lost<v id="2b"/>kept<v/>lost</book>'))
    assert rows(R.segment_walk(walk)) == [("RUT", 1, 2, "kept")]
    dump = R.whole_texts(spark, put(tmp_path, "a.sql", "INSERT INTO t VALUES (1,1,1,1,'a\\\\nb \\\\ c\\nd \\'e\\' f\\\\''g');"))
    assert rows(R.dump_values(dump), "text") == [("a\\nb \\ c d 'e' f\\'g",)]


def test_dump_and_fence(spark, tmp_path):
    dump = R.whole_texts(spark, put(tmp_path, "a.sql", r"INSERT INTO t VALUES (1, 8, 1, 1, 'It''s \'so\'\n now'),(2,8,1,2,'b');"))
    assert rows(R.dump_values(dump)) == [(8, 1, 1, "It's 'so' now"), (8, 1, 2, "b")]
    book = "junk 001:001\n*** START OF BOOK ***\nRUTH\n001:001 In the\n  days\n001:002 of old\n*** END OF BOOK ***\n001:003 no\n"
    fixed = spark.createDataFrame([("RUTH", 1, 2, "of yore")], R.UNIT)
    texts = R.whole_texts(spark, put(tmp_path, "b.txt", book))
    assert rows(R.fenced_verses(texts, fixed)) == [("RUTH", 1, 1, "In the days"), ("RUTH", 1, 2, "of yore")]


def test_compressed(spark, tmp_path):
    for name, words in (("a", (b"one", b"two")), ("c", (b"three",))):
        blocks = [zlib.compress(x) for x in words]
        at = [sum(map(len, blocks[:k])) for k in range(len(blocks))]
        put(tmp_path, f"{name}.idx", b"".join(struct.pack("<III", o, len(x), 3) for o, x in zip(at, blocks)) + struct.pack("<III", 0, 0, 0))
        put(tmp_path, f"{name}.dat", b"".join(blocks))
    assert rows(M.read(spark, str(tmp_path), "blocks")) == [("a", 0, "one"), ("a", 1, "two"), ("c", 0, "three")]
    assert rows(M.read(spark, str(tmp_path / "none"), "blocks")) == []
    put(tmp_path, "b.idx", b"")
    with pytest.raises(Exception, match="b.dat"):
        M.read(spark, str(tmp_path), "blocks").count()


def test_module_in_many_partitions(spark, tmp_path):
    """A module is read by runs of its blocks; filters on module and block are met by reading less."""
    texts = [f"text {k} " + "x" * (k % 50) for k in range(500)]
    blocks = [zlib.compress(t.encode()) if k % 7 else b"" for k, t in enumerate(texts)]
    at = [0]
    for b in blocks:
        at.append(at[-1] + len(b))
    index = b"".join(struct.pack("<III", o, len(b), 0) for o, b in zip(at, blocks))
    files = spark.createDataFrame([("one", index, b"".join(blocks)), ("a/b c", index[: 12 * 30], b"".join(blocks[:30]))], "module string, index binary, data binary")
    path = f"file://{tmp_path}/modules"
    assert M.write(files, path, "blocks") == 2
    df = M.read(spark, path, "blocks", 64)
    assert df.rdd.getNumPartitions() == 8 + 1
    wanted = {("one", k, t) for k, t in enumerate(texts) if k % 7} | {("a/b c", k, texts[k]) for k in range(30) if k % 7}
    assert set(rows(df)) == wanted
    some = df.where("module = 'one' and block >= 100 and block <= 227")
    assert some.rdd.getNumPartitions() == 2 and set(rows(some)) == {w for w in wanted if w[0] == "one" and 100 <= w[1] <= 227}
    assert set(rows(df.where("module in ('a/b c', 'x') and block = 8"))) == {("a/b c", 8, texts[8])}
    assert rows(df.where("module = 'none'")) == []
    assert rows(df.where("block = 8").select("body")) == [(texts[8],)] * 2


def test_module_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces are written one after the other, in whatever order they come; the queries pack modules by pieces of any size."""
    from stanzaline.plans import formats, registry

    texts = [f"text {k}" for k in range(60)]
    blocks = [zlib.compress(t.encode()) for t in texts]
    pieces = []
    for module in ("one", "two"):
        for piece in range(6):
            own, at = blocks[piece * 10 : piece * 10 + 10], [0]
            for b in own:
                at.append(at[-1] + len(b))
            pieces.append((module, piece, b"".join(struct.pack("<III", o, len(b), 0) for o, b in zip(at, own)), b"".join(own)))
    files = spark.createDataFrame(pieces[::-1], "module string, piece int, index binary, data binary").repartition(5)
    path = f"file://{tmp_path}/pieces"
    assert M.write(files, path, "blocks") == 2
    assert set(rows(M.read(spark, path, "blocks", 64))) == {(m, k, t) for m in ("one", "two") for k, t in enumerate(texts)}
    for name in ("s14_blocks", "s16_dictionary"):
        whole = rows(registry.queries()[name](spark, "/root/testdata/sf0.01"))
        with monkeypatch.context() as m:
            m.setattr(formats, "_PIECE", 12)
            modules = formats._modules(spark, "/root/testdata/sf0.01")
            assert modules.count() > 100 and modules.where("length(blocks) > 36").count() == 0
            assert sorted(rows(registry.queries()[name](spark, "/root/testdata/sf0.01"))) == sorted(whole)


def block(*texts):
    head, body = struct.pack("<I", len(texts)), b""
    for t in texts:
        head += struct.pack("<II", 4 + 8 * len(texts) + len(body), len(t) + 1)
        body += t + b"\0"
    return zlib.compress(head + body)


def test_dictionary(spark, tmp_path):
    """Keys and entries by block and entry, and each of the three faults; two modules side by side."""
    for name in ("m", "n"):
        entry = lambda t: b'<entryFree n="%s">%s of %s</entryFree>' % (t, t, name.encode())
        blocks = [block(entry(b"Aaron"), entry(b"Abel &amp; Co")), block(entry(b"Other"), entry(b"Lost"))]
        terms, keys = b"", b""
        for term, b, e in ((b"AARON", 0, 0), (b"ABEL &amp; CO", 0, 1), (b"CAIN", 1, 0), (b"GONE", 5, 0)):
            record = term + b"\r\n" + struct.pack("<II", b, e)
            keys += struct.pack("<II", len(terms), len(record))
            terms += record
        put(tmp_path, f"{name}.idx", keys)
        put(tmp_path, f"{name}.dat", terms)
        put(tmp_path, f"{name}.zdx", struct.pack("<IIII", 0, len(blocks[0]), len(blocks[0]), len(blocks[1])))
        put(tmp_path, f"{name}.zdt", b"".join(blocks))
    good, faults = M.keyed_entries(M.read(spark, str(tmp_path), "keys", 2), M.read(spark, str(tmp_path), "entries", 1))
    assert rows(good, "module", "nth", "term") == [(m, k, t) for m in "mn" for k, t in enumerate(("Aaron", "Abel & Co"))]
    assert all(r.text.endswith(f"of {r.module}</entryFree>") for r in good.collect())
    assert rows(faults) == [(m, *f) for m in "mn" for f in ((1, 0, "other term"), (1, 1, "no key"), (5, 0, "no entry"))]


def test_tables(spark, tmp_path):
    tsv = R.whole_texts(spark, put(tmp_path, "a.tsv", "about\nx\tKey\tWord\n1\tG1\tlogos\n2\tG2\n"))
    assert rows(R.headed_tsv(tsv, ["Key", "Word"]), "Key", "Word") == [("G1", "logos")]
    words = R.word_rows(spark, put(tmp_path, "b.tsv", "Rut.1.2#03\tw\tg\nhead\tx\ty\n"), ["ref", "word", "gloss"])
    assert rows(words) == [("Rut", 1, 2, 3, "w", "g")]
    xml = put(tmp_path, "c.xml", '<r><entry id="1"><w>aleph</w></entry><entry id="2"><w>beth</w></entry></r>')
    assert rows(R.xml_entries(spark, xml, "entry", "_id string, w string")) == [("1", "aleph"), ("2", "beth")]
    assert rows(R.xml_elements(R.whole_texts(spark, xml), "entry", "_id string, w string")) == [("1", "aleph"), ("2", "beth")]


def test_markup_pages(spark, tmp_path):
    page = R.whole_texts(spark, put(tmp_path, "a.html", '<a href="#t1">Faith</a><a name="t1"></a><p>Of faith</p><a name="zz"></a>lost'))
    assert rows(R.anchored_topics(page), "id", "label", "text") == [("t1", "Faith", "Of faith")]
    cells = R.table_cells(R.whole_texts(spark, put(tmp_path, "b.html", "<table><tr><td><p><i>Then stand</i></p><p>O Lord<table><td>in</td></table></p></td></tr></table>")))
    assert rows(cells, "cell", "paragraph", "rubric") == [(0, "O Lordin", False), (0, "Then stand", True)]
    wiki = R.wiki_pages(R.whole_texts(spark, put(tmp_path, "c.wiki", "{{a|x\n\ny}} [[l|one]]\n\n''two''")))
    assert rows(wiki, "block", "text") == [(0, "x\n\ny one"), (1, "two")]


def test_slices_and_heads(spark, tmp_path):
    texts = R.whole_texts(spark, put(tmp_path, "a.txt", "DC.Title: The Book\nBOOK Ruth\nCHAPTER 1\nIn the\ndays\nCHAPTER 2\nso\n"))
    ranges = spark.createDataFrame([("a.txt", "Ruth", 4, 5)], "file_name string, book string, low int, high int")
    assert rows(R.line_ranges(texts, ranges), "book", "line") == [("Ruth", "In the"), ("Ruth", "days")]
    assert rows(R.marked_chapters(texts)) == [("Ruth", 1, "In the days"), ("Ruth", 2, "so")]
    assert rows(R.header_fields(texts, ["Title"]), "title") == [("The Book",)]


def test_manifest_and_sinks(spark, tmp_path):
    path = put(tmp_path, "a.bin", b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("a.bin", good), ("b.bin", good)], "name string, sha256 string")
    assert rows(R.verified_files(spark, path, manifest), "name") == [("b.bin",)]
    store = str(tmp_path / "store")
    assert sinks.open_store(spark, store, "a int").count() == 0
    sinks.append(spark.createDataFrame([(1,)], "a int"), store)
    sinks.append(spark.createDataFrame([(2,)], "a int"), store)
    assert rows(sinks.open_store(spark, store, "a int")) == [(1,), (2,)]
    sinks.report(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["a"] == 1
