"""Readers of text formats into (book, chapter, verse, text) rows or the like.

Files are read by Spark (whole texts, lines, binary files, JSON, XML); one file is the unit of work
where a format has a state. Formats that need a parser run in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

UNIT = "book string, chapter int, verse int, text string"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def lines(texts: DataFrame, body: str = "body") -> DataFrame:
    """Rows of (file, line_no, line), numbered from 1."""
    split = texts.select("file", F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n", -1)).alias("at", "line"))
    return split.select("file", (F.col("at") + 1).alias("line_no"), "line")


def json_config(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The entries of an array field of a JSON file."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("entry")).select("entry.*")


def config_entries(texts: DataFrame, field: str, entry: str) -> DataFrame:
    """As json_config, of texts that are JSON; ``entry`` is the schema of one entry."""
    return texts.select(F.explode(F.from_json("body", f"{field} array<struct<{entry}>>")[field]).alias("entry")).select("entry.*")


def json_chapter_maps(texts: DataFrame) -> DataFrame:
    """``{"book": .., "chapters": {"1": {"1": text}}}``: maps unfolded twice."""
    rows = texts.select(F.from_json("body", "book string, chapters map<string, map<string, string>>").alias("j"))
    per = rows.select("j.book", F.explode("j.chapters").alias("chapter", "verses"))
    return per.select("book", F.col("chapter").try_cast("int").alias("chapter"), F.explode("verses").alias("verse", "text")).select("book", "chapter", F.col("verse").try_cast("int").alias("verse"), "text")


def json_nested(texts: DataFrame) -> DataFrame:
    """``{"books": [{"name", "chapters": [{"chapter", "verses": [{"verse", "text"}]}]}]}``."""
    schema = "books array<struct<name string, chapters array<struct<chapter int, verses array<struct<verse int, text string>>>>>>"
    per = texts.select(F.explode(F.from_json("body", schema)["books"]).alias("b")).select(F.col("b.name").alias("book"), F.explode("b.chapters").alias("c"))
    return per.select("book", F.col("c.chapter").alias("chapter"), F.explode("c.verses").alias("v")).select("book", "chapter", "v.verse", "v.text")


def markers_whole(texts: DataFrame) -> DataFrame:
    r"""Backslash-marked text as one stream: ``\id B``, ``\c n``, ``\v n text``; other markers are dropped."""
    body = F.regexp_replace("body", r"(?s)\\f .*?\\f\*|\\x .*?\\x\*", " ")
    book = F.regexp_extract("body", r"\\id +([A-Za-z0-9]+)", 1)
    chapters = texts.select(book.alias("book"), F.posexplode(F.split(body, r"\\c +(?=[0-9])")).alias("at", "part")).where("at > 0")
    chapter = F.regexp_extract("part", "^([0-9]+)", 1).try_cast("int")
    verses = chapters.select("book", chapter.alias("chapter"), F.posexplode(F.split("part", r"\\v +(?=[0-9])")).alias("at", "v")).where("at > 0")
    return verses.select("book", "chapter", F.regexp_extract("v", "^([0-9]+)", 1).try_cast("int").alias("verse"), T.strip_backslash_markers(F.regexp_replace("v", "^[0-9]+ *", "")).alias("text"))


def markers_by_line(texts: DataFrame) -> DataFrame:
    r"""The same markers line by line: book and chapter are carried forward, lines without a verse continue the last one, empty verses go."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines(texts)
    own = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    marked = marked.withColumn("b", own(r"^\\id +([A-Za-z0-9]+)")).withColumn("c", own(r"^\\c +([0-9]+)")).withColumn("v", own(r"^\\v +([0-9]+)"))
    carried = marked.withColumn("book", F.last("b", True).over(w)).withColumn("chapter", F.last("c", True).over(w)).withColumn("starts", F.sum(F.when(F.col("v").isNotNull() | F.col("c").isNotNull(), 1).otherwise(0)).over(w)).withColumn("verse", F.when(F.col("c").isNull(), F.last("v", True).over(w)))
    body = carried.where("b is null and c is null and verse is not null and starts > 0").withColumn("piece", T.strip_backslash_markers(F.regexp_replace("line", r"^\\v +[0-9]+ *", "")))
    # a chapter marker ends the verse before it
    per = body.groupBy("file", "book", "chapter", "starts").agg(F.first("verse").alias("verse"), F.array_sort(F.collect_list(F.struct("line_no", "piece"))).alias("p"))
    joined = per.select("book", F.col("chapter").cast("int").alias("chapter"), F.col("verse").cast("int").alias("verse"), T.squeeze(F.array_join(F.transform("p", lambda x: x["piece"]), " ")).alias("text"))
    return joined.where("text <> ''")


def marked_verse_lines(texts: DataFrame, books: list[str]) -> DataFrame:
    r"""Lines of ``\id``, ``\c`` and ``\v`` markers of the books that are named; verse is a text, so that ``3-4`` stays.

    Lines without a marker continue a verse, lines of any other marker do not; a chapter ends the verse
    before it; files of other books and verses without text go.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = lambda p, g=1: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    rows = lines(texts).withColumn("line", F.trim(F.replace("line", F.lit("\ufeff"), F.lit("")))).where("line <> ''")
    rows = rows.withColumn("b", own(r"^\\id +(\S+)")).withColumn("c", own(r"^\\c\s+([0-9]+)")).withColumn("v", own(r"^\\v\s+(\S+)"))
    rows = rows.withColumn("book", F.last("b", True).over(w)).where(F.col("book").isin(books))
    opens = F.when(F.col("v").isNotNull() | F.col("c").isNotNull(), F.col("line_no"))
    rows = rows.withColumn("chapter", F.last("c", True).over(w)).withColumn("opened", F.last(opens, True).over(w))
    part = F.when(F.col("v").isNotNull(), F.regexp_extract("line", r"^\\v\s+\S+\s?(.*)$", 1)).when(~F.col("line").startswith("\\"), F.col("line"))
    per = rows.where("opened is not null").groupBy("file", "book", "chapter", "opened").agg(F.max("v").alias("verse"), F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("line_no", part.alias("part"))))).alias("p"))
    text = T.strip_backslash_markers(F.array_join(F.transform("p", lambda x: x["part"]), " "))
    return per.where("verse is not null and chapter is not null").select("book", F.col("chapter").cast("int").alias("chapter"), "verse", text.alias("text")).where("text <> ''")


def tagged_verses(texts: DataFrame) -> DataFrame:
    """``<v id="n" bcv="BOOK.c.v"/>text<ve/>``: notes and headings dropped, other tags unwrapped."""
    found = F.regexp_extract_all("body", F.lit(r'(?s)<v +id="[0-9]+" +bcv="([A-Z0-9]+\.[0-9]+\.[0-9]+)" */>(?:.*?)<ve */>'), F.lit(0))
    rows = texts.select(F.explode(found).alias("m"))
    key = F.split(F.regexp_extract("m", r'bcv="([^"]+)"', 1), r"\.")
    out = rows.select(key[0].alias("book"), key[1].try_cast("int").alias("chapter"), key[2].try_cast("int").alias("verse"), T.unwrap_markup(F.regexp_replace("m", r"(?s)^<v [^>]*/>|<ve */>$", "")).alias("text"))
    return out.where("text <> ''")


def segment_walk(texts: DataFrame) -> DataFrame:
    """``<book id><c id/><v id/>..``: segments by a stack of open elements; text in a note or heading is left out."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = re.compile(r"<(/?)([A-Za-z]+)([^>]*?)(/?)>|([^<]+)")
        # parts of a batch, so that only a part's rows and tokens are there at a time
        for part in (batch["body"].iloc[at : at + 128] for batch in batches for at in range(0, len(batch), 128)):
            rows = []
            for body in part:
                book, chapter, verse, stack, parts = "", 0, 0, [], []

                def close():
                    text = " ".join("".join(parts).split())
                    if book and chapter and verse and text:
                        rows.append((book, chapter, verse, text))
                    parts.clear()

                for end, name, attrs, empty, data in (m.groups("") for m in token.finditer(body or "")):
                    if data:
                        if not {"f", "x", "s"} & set(stack):
                            parts.append(data)
                    elif name in ("book", "c", "v") and not end:
                        close()
                        at = re.search(r'id="([^"]+)"', attrs)
                        value = at[1] if at else ""
                        if name == "book":
                            book, chapter, verse = value, 0, 0
                        else:
                            # what has no number is no chapter or verse, and its text is left out
                            number = int(digits[0]) if (digits := re.match(r"\d{1,9}", value)) else 0
                            chapter, verse = (number, 0) if name == "c" else (chapter, number)
                    elif end and name in stack:
                        while stack.pop() != name:
                            pass
                    elif not empty and not end:
                        stack.append(name)
                close()
            yield pd.DataFrame(rows, columns=["book", "chapter", "verse", "text"])

    return texts.select("body").mapInPandas(walk, UNIT)


def dump_values(texts: DataFrame) -> DataFrame:
    """Rows ``(id, book, chapter, verse, 'text')`` of a MySQL dump, the literal without its escapes."""
    # unrolled and possessive, so that a long literal takes no stack
    inside = r"[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+"
    literal = f"'{inside}'"
    found = F.regexp_extract_all("body", F.lit(rf"\(\d+,\s*\d+,\s*\d+,\s*\d+,\s*{literal}\)"), F.lit(0))
    rows = texts.select(F.explode(found).alias("m"))
    part = lambda n: F.regexp_extract("m", r"\((\d+),\s*(\d+),\s*(\d+),\s*(\d+),", n).cast("int")
    inner = F.regexp_extract("m", rf"(?s),\s*'({inside})'\)$", 1)
    # pairs of backslashes first, from the left, so that one that is escaped escapes nothing
    held = F.regexp_replace(inner, r"\\\\", _HELD)
    plain = F.regexp_replace(F.regexp_replace(F.replace(held, F.lit("''"), F.lit("'")), r"\\[nrt]", " "), r"\\(.)", "$1")
    return rows.select(part(2).alias("book_id"), part(3).alias("chapter"), part(4).alias("verse"), T.squeeze(F.replace(plain, F.lit(_HELD), F.lit("\\"))).alias("text"))


#: Stands for a backslash while others are taken for escapes: a private character that no text uses.
_HELD = "\ue000"


def fenced_verses(texts: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Between ``*** START`` and ``*** END``: headings in capitals name the book, ``CCC:VVV`` opens a verse; (book, chapter, verse, text) corrections win."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(texts)
    inside = F.sum(F.col("line").startswith("*** START").cast("int")).over(w) - F.sum(F.col("line").startswith("*** END").cast("int")).over(w)
    rows = rows.withColumn("inside", inside).where("inside = 1 and not startswith(line, '***')")
    key = F.nullif(F.regexp_extract("line", r"^([0-9]{3}:[0-9]{3})", 1), F.lit(""))
    head = F.when(F.col("line").rlike("^[A-Z0-9][A-Z0-9 ]+$"), F.trim("line"))
    rows = rows.withColumn("book", F.last(head, True).over(w)).withColumn("k", F.last(key, True).over(w)).where(head.isNull() & F.col("k").isNotNull())
    per = rows.groupBy("book", "k").agg(F.array_sort(F.collect_list(F.struct("file", "line_no", "line"))).alias("p"))
    text = T.squeeze(F.array_join(F.transform("p", lambda x: F.regexp_replace(x["line"], r"^[0-9]{3}:[0-9]{3}", "")), " "))
    out = per.select("book", F.substring("k", 1, 3).cast("int").alias("chapter"), F.substring("k", 5, 3).cast("int").alias("verse"), text.alias("text"))
    if corrections is None:
        return out
    fixed = corrections.select("book", "chapter", "verse", F.col("text").alias("fixed"))
    return out.join(fixed, ["book", "chapter", "verse"], "left").select("book", "chapter", "verse", F.coalesce("fixed", "text").alias("text"))


def xml_entries(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of an XML file as rows; attributes are columns that begin with an underscore."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def xml_elements(texts: DataFrame, tag: str, schema: str) -> DataFrame:
    """As xml_entries, of texts; an element holds none of its own name."""
    found = F.regexp_extract_all("body", F.lit(rf"(?s)<{tag}[ >].*?</{tag}>"), F.lit(0))
    return texts.select(F.explode(found).alias("m")).select(F.from_xml("m", schema).alias("e")).select("e.*")


def headed_tsv(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns by name of a TSV whose header is the first line that has them all; short rows go. A header is a line per file."""
    rows = lines(texts).withColumn("cells", F.split("line", "\t", -1))
    heads = rows.where(F.size(F.array_intersect("cells", F.lit(wanted))) == len(set(wanted))).groupBy("file").agg(F.min_by(F.struct("line_no", "cells"), "line_no").alias("h"))
    met = rows.join(heads, "file").where("line_no > h.line_no and size(cells) >= size(h.cells)")
    pick = lambda c: F.element_at("cells", F.array_position("h.cells", F.lit(c)).cast("int")).alias(c)
    return met.select("file", "line_no", *(pick(c) for c in wanted))


def word_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """TSV rows whose first cell is an address ``Book.c.v#n``."""
    return addressed_words(spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"{n} string" for n in names)))


def addressed_words(rows: DataFrame) -> DataFrame:
    """Rows whose first column is an address ``Book.c.v#n``, with its parts in place of it."""
    pattern = r"^([1-3]?[A-Za-z]+)\.([0-9]+)\.([0-9]+)#([0-9]+)"
    own = F.col(rows.columns[0])
    part = lambda n: F.regexp_extract(own, pattern, n)
    return rows.where(own.rlike(pattern)).select(part(1).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse"), part(4).cast("int").alias("position"), *rows.columns[1:])


def anchored_topics(texts: DataFrame) -> DataFrame:
    """HTML split at ``<a name="id">``, each part with the label that a table of contents gives it."""
    toc = texts.select("file", F.explode(F.regexp_extract_all("body", F.lit('<a href="#([^"]+)">([^<]*)</a>'), F.lit(0))).alias("m"))
    toc = toc.select("file", F.regexp_extract("m", '"#([^"]+)"', 1).alias("id"), F.regexp_extract("m", ">([^<]*)<", 1).alias("label"))
    parts = texts.select("file", F.posexplode(F.split("body", '<a name="')).alias("at", "part")).where("at > 0")
    parts = parts.select("file", "at", F.regexp_extract("part", '^([^"]+)"', 1).alias("id"), T.strip_tags(F.regexp_replace("part", '(?s)^[^"]+"[^>]*>', "")).alias("text"))
    return parts.join(toc, ["file", "id"]).select("id", "label", "at", "text")


def table_cells(texts: DataFrame) -> DataFrame:
    """Outermost table cells by depth, their paragraphs, and whether italics make a rubric of one."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, body in zip(batch["file"], batch["body"]):
                depth, start, n = 0, 0, 0
                for m in re.finditer(r"<(/?)td\b[^>]*>", body or "", re.I):
                    depth += -1 if m[1] else 1
                    if not m[1] and depth == 1:
                        start = m.end()
                    elif m[1] and depth == 0:
                        for p in re.split(r"</p>|<br */?>\s*<br */?>", body[start : m.start()]):
                            plain = " ".join(re.sub("<[^>]+>", "", p).split())
                            italic = sum(len(re.sub("<[^>]+>", "", i)) for i in re.findall(r"(?s)<i>(.*?)</i>", p))
                            if plain:
                                rows.append((file, n, plain, italic > 0.85 * len(plain)))
                        n += 1
            yield pd.DataFrame(rows, columns=["file", "cell", "paragraph", "rubric"])

    return texts.select("file", "body").mapInPandas(cells, "file string, cell int, paragraph string, rubric boolean")


def wiki_pages(texts: DataFrame) -> DataFrame:
    """Blocks of wikitext pages, split at blank lines outside templates and links."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, body in zip(batch["file"], batch["body"]):
                depth, last, n = 0, 0, 0
                body = body or ""
                for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\n\s*\n|\Z", body):
                    if m[0] in ("{{", "[["):
                        depth += 1
                    elif m[0] in ("}}", "]]"):
                        depth = max(0, depth - 1)
                    elif depth == 0 or m.start() == len(body):
                        if block := T.render_wiki(body[last : m.start()]):
                            rows.append((file, n, block))
                            n += 1
                        last = m.end()
            yield pd.DataFrame(rows, columns=["file", "block", "text"])

    return texts.select("file", "body").mapInPandas(blocks, "file string, block int, text string")


def line_ranges(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines of files by (file_name, book, low, high); ranges do not overlap within a file."""
    numbered = lines(texts).withColumn("file_name", F.element_at(F.split("file", "/"), -1))
    # an equality on the file and a residual on the line
    return numbered.join(ranges, "file_name").where(F.col("line_no").between(F.col("low"), F.col("high"))).select("book", "line_no", "line")


def marked_chapters(texts: DataFrame, book: str = r"^BOOK +(.+)$", chapter: str = r"^CHAPTER +([0-9]+)") -> DataFrame:
    """(book, chapter, text) between marker lines."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    rows = lines(texts).withColumn("b", own(book)).withColumn("c", own(chapter))
    rows = rows.withColumn("book", F.last("b", True).over(w)).withColumn("chapter", F.last("c", True).over(w)).where("b is null and c is null and chapter is not null and trim(line) <> ''")
    per = rows.groupBy("file", "book", "chapter").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("p"))
    return per.select("book", F.col("chapter").cast("int").alias("chapter"), F.array_join(F.transform("p", lambda x: F.trim(x["line"])), " ").alias("text"))


def header_fields(texts: DataFrame, names: list[str]) -> DataFrame:
    """Fields ``DC.Name: value`` or ``<DC.Name>value</DC.Name>`` of a document's head."""
    pick = lambda n: F.trim(F.regexp_extract("body", rf"(?im)(?:^DC\.{n}: *|<DC\.{n}[^>]*>)([^<\r\n]*)", 1)).alias(n.lower())
    return texts.select("file", *(pick(n) for n in names))


def unverified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, expected, actual) of files (name, content) whose SHA-256 is not the one that the manifest (name, sha256) states, or that are missing."""
    found = files.select("name", F.sha2("content", 256).alias("actual"))
    return manifest.join(found, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("actual"))).select("name", F.col("sha256").alias("expected"), "actual")


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``unverified`` of the files of a folder, by their names."""
    return unverified(spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"), manifest)
