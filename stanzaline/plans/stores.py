"""Sinks, tables and readers of whole files as registered queries: what was written is read again.

Tables and files go to a folder of their own in the one that driver and executors share; ``places.clear`` removes them.
"""

from __future__ import annotations

import uuid
from contextlib import suppress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources import readers as R
from ..sources import sinks
from ..sources.places import fresh_folder
from ..sources.versions import Conflict, VersionedTable
from . import lens
from .lens import query, table

_SQUEEZED = "trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"


def _texts(s, d) -> DataFrame:
    return lens.notes(s, d).select("id", "source_id", "text")


@query("s03_store", "select id, source_id, text from notes", "notes")
def _(s, d):
    """A store that is made when it is first written to, and read as an empty one before."""
    path, rows = fresh_folder(s, "store"), _texts(s, d)
    before = sinks.open_store(s, path, "id bigint, source_id string, text string")
    sinks.append(before.unionByName(rows), path)
    return sinks.open_store(s, path, "id bigint, source_id string, text string")


@query("s28_append", "select id, text from notes union all select id, text from notes where id % 3 = 0", "notes")
def _(s, d):
    path, rows = fresh_folder(s, "append"), _texts(s, d).select("id", "text")
    sinks.append(rows, path)
    sinks.append(rows.where("id % 3 = 0"), path)
    return s.read.parquet(path)


@query("s29_batches", "select id, text from notes", "notes")
def _(s, d):
    """Three batches by key, written in one pass and committed together."""
    store, rows = VersionedTable(s, fresh_folder(s, "batches"), "batch"), _texts(s, d).select("id", "text", (F.col("id") % 3).alias("batch"))
    store.append(rows).commit()
    return store.read().select("id", "text")


@query("s30_rebuild", "select id, text from notes where id % 2 = 0", "notes")
def _(s, d):
    """A second version takes the place of the first as a whole."""
    store, rows = VersionedTable(s, fresh_folder(s, "rebuild")), _texts(s, d).select("id", "text")
    store.append(rows).commit()
    store.replace(rows.where("id % 2 = 0")).commit()
    return store.read()


@query("s31_partition_replace", "select id, source_id, case when source_id in ('Brand#2', 'Brand#13') then upper(text) else text end as text from notes where source_id not in ('Brand#2', 'Brand#13') or id % 2 = 0", "notes")
def _(s, d):
    """Two sources are written anew, half of their rows, and swapped together; the others stay."""
    store, rows = VersionedTable(s, fresh_folder(s, "parts"), "source_id"), _texts(s, d)
    store.append(rows).commit()
    store.replace_partitions(rows.where("source_id in ('Brand#2', 'Brand#13') and id % 2 = 0").withColumn("text", F.upper("text"))).commit()
    return store.read()


@query("s32_report", "select source_id, count(*) as n, min(text) as first from notes group by source_id", "notes")
def _(s, d):
    path = fresh_folder(s, "report")
    sinks.report(_texts(s, d).groupBy("source_id").agg(F.count("*").alias("n"), F.min("text").alias("first")), path)
    return s.read.schema("source_id string, n bigint, first string").json(path)


@query("s34_copy_table", "select id as note_id, text as body from notes", "notes")
def _(s, d):
    """A table by its catalog entry, with columns renamed."""
    name = f"stanzaline_{uuid.uuid4().hex}"
    _texts(s, d).select("id", "text").write.saveAsTable(name)
    return L.copy_table(s, name, f"{name}_copy", {"id": "note_id", "text": "body"})


@query("l07_merge_once", "select id, text from notes where id % 2 = 1", "notes")
def _(s, d):
    """Two merges that begin from the same empty table: the second does nothing."""
    store, rows = VersionedTable(s, fresh_folder(s, "merge")), _texts(s, d).select("id", "text")
    first, second = store.append(rows.where("id % 2 = 1")), store.append(rows.where("id % 2 = 0"))
    first.commit()
    with suppress(Conflict):
        second.commit()
    return store.read()


@query("m02_checksums", "select cast(doc_id as varchar) as name, case when doc_id % 10 = 3 then sha256('other') else sha256(text) end as expected, case when doc_id % 10 <> 7 then sha256(text) end as actual from documents where doc_id % 10 in (3, 7)")
def _(s, d):
    """Files that differ from their manifest, and files that are missing."""
    docs = table(s, d, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    stated = docs.select("name", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.lit("other").cast("binary")).otherwise(F.col("content")), 256).alias("sha256"))
    return R.unverified(docs.where("doc_id % 10 <> 7"), stated)


# ---- readers of whole files


def _by_book(s, d, verse) -> DataFrame:
    """(book, chapters): each book's chapters in order, an array of (chapter, verses as ``verse`` makes them of number and text)."""
    per = lens.lessons(s, d).groupBy("book", "chapter").agg(F.array_sort(F.collect_list(F.struct("verse_no", "text"))).alias("v"))
    per = per.select("book", "chapter", F.transform("v", lambda x: verse(x["verse_no"], x["text"])).alias("v"))
    return per.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", "v"))).alias("chapters"))


_LESSON_ROWS = "select book, cast(chapter as int) as chapter, verse_no as verse, md5(text) as h from lessons"


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("book", "chapter", "verse", F.md5("text").alias("h"))


@query("s04_config", "select mood, label from (select p_brand as mood, p_name as label from part)")
def _(s, d):
    entries = F.collect_list(F.struct(F.col("p_brand").alias("mood"), F.col("p_name").alias("label"), F.col("p_size").alias("more")))
    files = table(s, d, "part").groupBy(F.col("p_size").cast("string").alias("file")).agg(F.to_json(F.struct(entries.alias("moods"))).alias("body"))
    return R.config_entries(files, "moods", "mood string, label string")


@query("s05_chapter_maps", _LESSON_ROWS, "units lessons")
def _(s, d):
    books = _by_book(s, d, lambda n, x: F.struct(n.cast("string").alias("key"), x.alias("value")))
    maps = F.map_from_entries(F.transform("chapters", lambda c: F.struct(c["chapter"].cast("string"), F.map_from_entries(c["v"]))))
    return _hashed(R.json_chapter_maps(books.select("book", F.to_json(F.struct("book", maps.alias("chapters"))).alias("body"))))


@query("s06_nested_books", _LESSON_ROWS, "units lessons")
def _(s, d):
    books = _by_book(s, d, lambda n, x: F.struct(n.alias("verse"), x.alias("text")))
    one = F.struct(F.col("book").alias("name"), F.transform("chapters", lambda c: F.struct(c["chapter"].alias("chapter"), c["v"].alias("verses"))).alias("chapters"))
    return _hashed(R.json_nested(books.select(F.to_json(F.struct(F.array(one).alias("books"))).alias("body"))))


@query("s13_fenced_verses", f"select upper(book) as book, cast(chapter as int) as chapter, verse_no as verse, md5(case when chapter = 2 and verse_no = 1 then 'corrected' else {_SQUEEZED} end) as h from lessons where {_SQUEEZED} <> ''", "units lessons")
def _(s, d):
    """Each book between its fences, every verse on two lines, with corrections of some."""
    verse = lambda c: F.transform(c["v"], lambda x: F.concat(F.lpad(c["chapter"].cast("string"), 3, "0"), F.lit(":"), F.lpad(x["n"].cast("string"), 3, "0"), F.lit("\n "), x["x"]))
    books = _by_book(s, d, lambda n, x: F.struct(n.alias("n"), x.alias("x")))
    body = F.concat(F.lit("junk 001:001\n*** START\n"), F.upper("book"), F.lit("\n"), F.array_join(F.flatten(F.transform("chapters", verse)), "\n"), F.lit("\n*** END\n009:009 no\n"))
    fixed = lens.lessons(s, d).where("chapter = 2 and verse_no = 1").select(F.upper("book").alias("book"), F.col("chapter").cast("int").alias("chapter"), F.col("verse_no").alias("verse"), F.lit("corrected").alias("text")).distinct()
    return _hashed(R.fenced_verses(books.select(F.col("book").alias("file"), body.alias("body")), fixed))


@query("s17_lexicon_entries", "select cast(p_partkey as varchar) as id, p_name as w, p_brand as note from part")
def _(s, d):
    """Elements with an attribute, a text and a nested one, of a file for each size."""
    entry = F.concat(F.lit('<entry id="'), F.col("p_partkey").cast("string"), F.lit('"><w>'), F.col("p_name"), F.lit("</w><more><note>"), F.col("p_brand"), F.lit("</note></more></entry>"))
    files = table(s, d, "part").groupBy("p_size").agg(F.concat(F.lit("<lexicon>\n"), F.array_join(F.collect_list(entry), "\n"), F.lit("</lexicon>")).alias("body"))
    return R.xml_elements(files, "entry", "_id string, w string, more struct<note: string>").select(F.col("_id").alias("id"), "w", F.col("more.note").alias("note"))


@query("s19_word_rows", "select split_part(p_name, ' ', 1) as book, cast(p_size as int) as chapter, cast(p_partkey % 50 as int) as verse, cast(p_partkey % 7 as int) as position, p_brand as word from part where p_partkey % 5 <> 0")
def _(s, d):
    """Rows of words, every fifth with another kind of first cell."""
    first = F.when(F.col("p_partkey") % 5 == 0, F.lit("# Word")).otherwise(F.format_string("%s.%d.%d#%02d", F.substring_index("p_name", " ", 1), "p_size", F.col("p_partkey") % 50, F.col("p_partkey") % 7))
    return R.addressed_words(table(s, d, "part").select(first.alias("ref"), F.col("p_brand").alias("word")))
