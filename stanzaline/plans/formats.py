"""The format readers, run over the tables' texts written in each format, and header grammars."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import headers as H
from ..operators.scans import number
from ..operators.search_index import counted
from ..sources import modules as M
from ..sources import readers as R
from ..sources.places import fresh_folder
from . import lens
from .lens import query, table

_WS = "[ \\t\\r\\n\\f\\x0B]+"
_MARKED = rf"trim(regexp_replace(replace(regexp_replace(text, '\\[a-zA-Z]+[0-9]*\*?', '', 'g'), '|', ''), '{_WS}', ' ', 'g'))"


def _body(head, line, joiner="\n"):
    """One file for each document: a head, then each line that is not blank as ``line(number, text)`` gives it."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).cast("string").alias("n"), x.alias("x")))
    kept = F.filter(numbered, lambda s: F.trim(s["x"]) != "")
    return F.concat(head, F.array_join(F.transform(kept, lambda s: line(s["n"], s["x"])), joiner))


def _files(s, d, head, line, joiner="\n"):
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), _body(head, line, joiner).alias("body"))


def _marked(s, d):
    head = F.concat(F.lit("\\id "), F.col("source"), F.lit("\n\\c "), F.col("doc_id").cast("string"), F.lit("\n"))
    return _files(s, d, head, lambda n, x: F.concat(F.lit("\\v "), n, F.lit(" "), x))


def _hashed(df):
    return df.select("book", "chapter", "verse", F.md5("text").alias("h"))


_UNITS_MARKED = f"select book, cast(chapter as int) as chapter, verse_no as verse, md5({_MARKED}) as h from units where {_MARKED} <> ''"


@query("s07_marker_stream", _UNITS_MARKED, "units")
def _(s, d):
    return _hashed(R.markers_whole(_marked(s, d)).where("text <> ''"))


@query("s08_marker_lines", _UNITS_MARKED, "units")
def _(s, d):
    return _hashed(R.markers_by_line(_marked(s, d)))


_ENT = "replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&mdash;', '\u2014'), '&ndash;', '\u2013'), '&amp;', '&')"
_UNWRAPPED = "trim(regexp_replace(" + _ENT.format("regexp_replace(text, '<[^>]+>', '', 'g')") + f", '{_WS}', ' ', 'g'))"


@query("s09_tagged_verses", f"select upper(book) as book, cast(chapter as int) as chapter, verse_no as verse, md5({_UNWRAPPED}) as h from units where {_UNWRAPPED} <> ''", "units")
def _(s, d):
    line = lambda n, x: F.concat(F.lit('<v id="'), n, F.lit('" bcv="'), F.upper("source"), F.lit("."), F.col("doc_id").cast("string"), F.lit("."), n, F.lit('"/>'), x, F.lit("<ve/>"))
    return _hashed(R.tagged_verses(_files(s, d, F.lit(""), line)))


@query("s11_segments")
def _(s, d):
    head = F.concat(F.lit('<book id="'), F.col("source"), F.lit('"><c id="'), F.col("doc_id").cast("string"), F.lit('"/>'))
    return _hashed(R.segment_walk(_files(s, d, head, lambda n, x: F.concat(F.lit('<v id="'), n, F.lit('"/>'), x))))


@query("s10_verse_lines", f"select 'R' || upper(book) as book, cast(chapter as int) as chapter, verse || '-' || verse as verse, md5({_MARKED}) as h from units where {_MARKED} <> '' and book in ('src1', 'src2', 'src3', 'src5', 'src8', 'src13')", "units")
def _(s, d):
    """Files of all books, of which some are named; a marker line stands before every verse."""
    head = F.concat(F.lit("\\id R"), F.upper("source"), F.lit(" x\n\\h x\n\\c "), F.col("doc_id").cast("string"), F.lit("\n"))
    line = lambda n, x: F.concat(F.lit("\\p\n\\v "), n, F.lit("-"), n, F.lit(" "), x)
    named = [f"RSRC{k}" for k in (1, 2, 3, 5, 8, 13)]
    return _hashed(R.marked_verse_lines(_files(s, d, head, line), named))


@query("s12_dump_values", f"select book_order as book_id, cast(chapter as int) as chapter, verse_no as verse, md5(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) as h from units", "units")
def _(s, d):
    literal = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    row = F.concat(F.lit("(1,"), F.concat_ws(",", F.col("book_order").cast("string"), F.col("chapter").cast("string"), "verse"), F.lit(",'"), literal, F.lit("')"))
    found = R.dump_values(lens.units(s, d).select(F.lit("x").alias("file"), row.alias("body")))
    return found.select("book_id", "chapter", "verse", F.md5("text").alias("h"))


#: Parts in a piece of a module: whole blocks of four and of three.
_PIECE = 3072


def _modules(s, d):
    """Each brand's parts as a compressed module: blocks of four names, a dictionary in blocks of three entries, and its key index; in pieces."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p_partkey")
        piece = int(part["piece"].iloc[0])
        names, keys = [n.encode() for n in part["p_name"]], part["p_partkey"].tolist()
        texts = [zlib.compress(b"|".join(names[k : k + 4])) for k in range(0, len(names), 4)]
        at = np.cumsum([0, *map(len, texts)])
        blocks = b"".join(struct.pack("<III", o, len(t), 0) for o, t in zip(at, texts))
        entries = [b'<entryFree n="Part %d &amp; all">%s</entryFree>' % (k, n) for k, n in zip(keys, names)]
        packed = []
        for k in range(0, len(entries), 3):
            own = entries[k : k + 3]
            start = 4 + 8 * len(own)
            packed.append(zlib.compress(struct.pack("<I", len(own)) + b"".join(struct.pack("<II", start + sum(map(len, own[:i])), len(e)) for i, e in enumerate(own)) + b"".join(own)))
        places = np.cumsum([0, *map(len, packed)])
        records = [b"PART %d &amp; ALL\r\n" % k + struct.pack("<II", i // 3, i % 3) for i, k in enumerate(keys, piece * _PIECE)]
        found = np.cumsum([0, *map(len, records)])
        row = (part["p_brand"].iloc[0], piece, blocks, b"".join(texts), b"".join(struct.pack("<II", o, len(r)) for o, r in zip(found, records)), b"".join(records), b"".join(struct.pack("<II", o, len(p)) for o, p in zip(places, packed)), b"".join(packed))
        return pd.DataFrame([row], columns=["module", "piece", "blocks", "texts", "keys", "terms", "index", "data"])

    parts = table(s, d, "part").select("p_brand", "p_partkey", "p_name")
    numbered = number(parts, ["p_brand"], ["p_partkey"], "nth").withColumn("piece", F.floor((F.col("nth") - 1) / _PIECE).cast("int"))
    return numbered.groupBy("p_brand", "piece").applyInPandas(pack, "module string, piece int, blocks binary, texts binary, keys binary, terms binary, index binary, data binary")


@query("s14_blocks", "select module, cast(block as int) as block, md5(string_agg(p_name, '|' order by p_partkey)) as h from (select p_brand as module, (row_number() over (partition by p_brand order by p_partkey) - 1) // 4 as block, p_name, p_partkey from part) group by all")
def _(s, d):
    path = fresh_folder(s, "blocks")
    M.write(_modules(s, d).select("module", "piece", F.col("blocks").alias("index"), F.col("texts").alias("data")), path, "blocks")
    return M.read(s, path, "blocks", 64).select("module", "block", F.md5("body").alias("h"))


@query("s15_entries", "select module, cast(nth // 3 as int) as block, cast(nth % 3 as int) as entry, p_name as text from (select p_brand as module, row_number() over (partition by p_brand order by p_partkey) - 1 as nth, p_name from part)")
def _(s, d):
    path = fresh_folder(s, "entries")
    M.write(_modules(s, d), path, "entries")
    return M.read(s, path, "entries", 64).select("module", "block", "entry", F.regexp_replace("text", "<[^>]*>", "").alias("text"))


@query("s16_dictionary", "select p_brand as module, 'Part ' || p_partkey || ' & all' as term, p_name as text from part")
def _(s, d):
    path, files = fresh_folder(s, "dictionary"), _modules(s, d)
    M.write(files, path, "entries")
    M.write(files.select("module", "piece", F.col("keys").alias("index"), F.col("terms").alias("data")), path, "keys")
    good, _ = M.keyed_entries(M.read(s, path, "keys", 256), M.read(s, path, "entries", 64))
    return good.select("module", "term", F.regexp_replace("text", "<[^>]*>", "").alias("text"))


@query("s18_headed_tsv", "select p_partkey as k, p_name as word from part")
def _(s, d):
    rows = F.array_join(F.collect_list(F.concat_ws("\t", F.lit("x"), F.col("p_partkey").cast("string"), "p_name")), "\n")
    files = table(s, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.concat(F.lit("about\nn\tkey\tword\n"), rows).alias("body"))
    return R.headed_tsv(files, ["key", "word"]).select(F.col("key").cast("long").alias("k"), "word")


@query("s20_anchored_topics", "select cast(p_partkey as varchar) as id, p_brand as label, p_name as text from part")
def _(s, d):
    key = F.col("p_partkey").cast("string")
    body = F.concat(F.lit('<a href="#'), key, F.lit('">'), F.col("p_brand"), F.lit('</a><a name="'), key, F.lit('"></a><p>'), F.col("p_name"), F.lit("</p>"))
    return R.anchored_topics(table(s, d, "part").select(key.alias("file"), body.alias("body"))).select("id", "label", "text")


@query("s21_table_cells", """select cast(p_partkey as varchar) as file, cast(cell as int) as cell, paragraph, rubric from (
select p_partkey, 0 as cell, p_name as paragraph, true as rubric from part union all select p_partkey, 0, p_brand || ' ' || p_size || ' & so', false from part union all select p_partkey, 1, 'and more of the ' || p_name, false from part union all select p_partkey, 1, 'y', false from part)""")
def _(s, d):
    """Two cells each, the first with a table inside, the second with two paragraphs parted by line breaks."""
    html = F.concat(F.lit("<table><tr><TD class='a'><p><i>"), F.col("p_name"), F.lit("</i></p><p>"), F.col("p_brand"), F.lit(" <table><td>"), F.col("p_size").cast("string"), F.lit("</td></table> &amp; so</p></TD><td>and more of the <i>"), F.col("p_name"), F.lit("</i><br/> <br>y</td></tr></table>"))
    found = R.table_cells(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("file"), html.alias("body")))
    return found.select("file", "cell", F.replace("paragraph", F.lit("&amp;"), F.lit("&")).alias("paragraph"), "rubric")


@query("s22_wiki_blocks")
def _(s, d):
    return R.wiki_pages(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("body"))).select("file", "block", F.md5("text").alias("h"))


@query("s23_line_ranges", "select cast(doc_id as varchar) as book, pos as line_no, line from (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as pos from (select doc_id, string_split(text, chr(10)) as l from documents)) where pos between 2 and 4")
def _(s, d):
    docs = table(s, d, "documents")
    ranges = docs.select(F.col("doc_id").cast("string").alias("file_name"), F.col("doc_id").cast("string").alias("book"), F.lit(2).alias("low"), F.lit(4).alias("high"))
    found = R.line_ranges(docs.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("body")), ranges)
    return found.select("book", F.col("line_no").cast("long").alias("line_no"), "line")


@query("s24_marked_chapters", "select book, cast(chapter as int) as chapter, md5(string_agg(trim(text), ' ' order by verse_no)) as h from units where not regexp_matches(text, '^(BOOK|CHAPTER) ') group by book, chapter", "units")
def _(s, d):
    head = F.concat(F.lit("BOOK "), F.col("source"), F.lit("\nCHAPTER "), F.col("doc_id").cast("string"), F.lit("\n"))
    return R.marked_chapters(_files(s, d, head, lambda n, x: x)).select("book", "chapter", F.md5("text").alias("h"))


@query("s27_header_fields", "select cast(doc_id as varchar) as file, source as title, lang as language from documents")
def _(s, d):
    body = F.concat(F.lit("DC.Title: "), F.col("source"), F.lit("\nDC.Language: "), F.col("lang"), F.lit("\n"))
    return R.header_fields(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), body.alias("body")), ["Title", "Language"])


@query("s33_index", "select doc_id, count(*) as tokens, count(*) filter (where term in ('the', 'thes')) as thes, count(*) filter (where term in ('in', 'ined', 'ines', 'ining')) as ins from tokens group by doc_id", "tokens")
def _(s, d):
    """The stored index, summed up by document, with two of its stems."""
    return counted(lens.index(s, d), ["the", "in"]).select(F.col("key").alias("doc_id"), "tokens", F.col("of")[0].alias("thes"), F.col("of")[1].alias("ins"))


_text = F.format_string


@query("g08_head_reference", """select p_partkey, case p_partkey % 6 when 0 then b || ' ' || k || ':' || n || '-' || k || ':' || n + 3 when 1 then b || ' ' || k || ':' || n || '-' || k || ':' || n
when 2 then 'Jude 1:' || k || '-1:' || k + 2 when 3 then 'Luke ' || k || ':' || n || '-' || k + 1 || ':2' when 4 then 'Psalms ' || k || ':2-' || k || ':2' else '' end as shown from formed""", "formed")
def _(s, d):
    forms = [_text("%s %d:%d-%d", F.upper("b"), "k", "n", F.col("n") + 3), _text("%s %d:%d.", "b", "k", "n"), _text("Jude %d-%d", "k", F.col("k") + 2), _text("%d:%d–%d:2", "k", "n", F.col("k") + 1), _text("psalm %d:2", "k"), _text("%s of %s", "w1", "w2")]
    asked = lens.formed(s, d, *forms).select("p_partkey", H.head_reference(F.col("raw"), F.lit("Luke")).alias("r"))
    shown = F.when(F.col("r").isNotNull(), _text("%s %d:%d-%d:%d", "r.book", "r.sc", "r.sv", "r.ec", "r.ev")).otherwise("")
    return asked.select("p_partkey", shown.alias("shown"))


@query("g13_chapter_heads", """select p_partkey, case p_partkey % 5 when 0 then k || ':' || n || '-' || k + 1 || ':26 The ' || w2 when 1 then k || ':1-' || k || ':0 ' when 2 then k || ':1-' || k || ':0 Blessed ' || w1 else '' end as shown from formed""", "formed")
def _(s, d):
    small, large = lens.roman_of(F.col("k")), lens.roman_of(F.col("k"), False)
    forms = [_text("Chap. %s. %d-%s. 26. The %s", small, "n", lens.roman_of(F.col("k") + 1), "w2"), _text("CHAP. %s.", large), _text("PSALM %s. Blessed %s", large, "w1"), _text("chap. %s. %d, with regard to", small, "n"), _text("%s %s", "w1", "w2")]
    asked = lens.formed(s, d, *forms).select("p_partkey", H.chapter_head(F.col("raw")).alias("h"))
    shown = _text("%d:%d-%d:%d %s", "h.sc", "h.sv", "h.ec", F.coalesce("h.ev", F.lit(0)), "h.title")
    return asked.select("p_partkey", F.when(F.col("h").isNotNull(), shown).otherwise("").alias("shown"))


@query("g13_verse_heads", """select p_partkey, case p_partkey % 5 when 0 then n || '-' || n || ' In ' || w1 when 1 then n || '-' || n + 1 || ' And' when 2 then n || '-' || n || ' So' else '' end as shown from formed""", "formed")
def _(s, d):
    forms = [_text("Ver. %d. In %s", "n", "w1"), _text("Vers. %d, %d. And", "n", F.col("n") + 1), _text("Vers. %d sq. So", "n"), _text("Ver. %d.", F.col("n") + 176), _text("ver. %d to", "n")]
    asked = lens.formed(s, d, *forms).select("p_partkey", H.verse_head(F.col("raw")).alias("h"))
    return asked.select("p_partkey", F.when(F.col("h").isNotNull(), _text("%d-%d %s", "h.sv", "h.ev", "h.rest")).otherwise("").alias("shown"))


@query("g13_running_heads", "select p_partkey, cast(case when p_partkey % 4 < 2 then k else -1 end as int) as chapter from formed", "formed")
def _(s, d):
    small, large = lens.roman_of(F.col("k")), lens.roman_of(F.col("k"), False)
    forms = [_text("CHAP. %s. 1-3. %d", large, "n"), _text("Chap. %s. 9 %d", small, F.col("n") + 100), _text("CHAP. %s. The %s 12", large, "w1"), _text("CHAP. %s.", large)]
    return lens.formed(s, d, *forms).select("p_partkey", F.coalesce(H.running_head(F.col("raw")), F.lit(-1)).alias("chapter"))


@query("g14_intro_titles", """select p_partkey, case p_partkey % 6 when 0 then b || ' ' || k when 1 then b || ' ' || k || '-' || k + 1 when 2 then '2 Peter 1' when 3 then '1 Kings ' || k when 4 then 'Ecclesiastes' else '' end as shown from formed""", "formed")
def _(s, d):
    forms = [_text("%s %d", F.upper("b"), "k"), _text("%s %d & %d", F.upper("b"), "k", F.col("k") + 1), F.lit("H PETER l"), _text("FIRST KING %d", "k"), _text("ECCLESIASTES, OR THE %s", F.upper("w1")), _text("%s %d", F.upper("w1"), "k")]
    asked = lens.formed(s, d, *forms).select("p_partkey", H.intro_title(F.col("raw")).alias("t"))
    more = lambda mark, c: F.coalesce(F.concat(F.lit(mark), F.col(c).cast("string")), F.lit(""))
    return asked.select("p_partkey", F.coalesce(F.concat("t.book", more(" ", "t.chapter"), more("-", "t.to_chapter")), F.lit("")).alias("shown"))


@query("g16_summary_ranges", """select p_partkey, case p_partkey % 2 when 0 then '1-' || n || ';' || k || '-' || k + 1 || ';3-5' else '' end as ranges, cast(case p_partkey % 2 when 0 then -1 else n end as int) as first_verse from formed""", "formed")
def _(s, d):
    forms = [_text("Of it, v. 1-%d. Then v. %d, %d and vv. 3–5, not ver. 9.", "n", "k", F.col("k") + 1), _text("%d And %s", "n", "w1")]
    ranges = F.array_join(F.transform(H.summary_ranges(F.col("raw")), lambda r: F.format_string("%d-%d", r["s"], r["e"])), ";")
    return lens.formed(s, d, *forms).select("p_partkey", ranges.alias("ranges"), F.coalesce(H.leading_verse(F.col("raw")), F.lit(-1)).alias("first_verse"))


@query("g16_summary_refs", """with c as (select book, chapter, max(verse_no) as top from lessons group by all)
select book, chapter, u.verse_no, u.text from c join (select distinct book, chapter, verse_no, text from lessons) u using (book, chapter) where u.verse_no = 1 or u.verse_no between 3 and 4 or u.verse_no = c.top""", "units lessons")
def _(s, d):
    """Each chapter's summary, which names some of its verses, and the lines that it names."""
    u = lens.lessons(s, d)
    summary = F.concat(F.lit("The matter, v. 1. That, vv. 3, 4, and in the end v. "), F.max("verse_no").cast("string"), F.lit("; see ver. 2."))
    refs = u.groupBy("book", "chapter").agg(summary.alias("summary")).select("book", "chapter", F.explode(H.summary_ranges(F.col("summary"))).alias("r"))
    named = refs.select("book", "chapter", F.explode(F.sequence("r.s", "r.e")).alias("verse_no")).distinct()
    return u.join(named, ["book", "chapter", "verse_no"]).select("book", "chapter", "verse_no", "text").distinct()


@query("x11_tei", "select p_partkey, p_name || chr(10) || p_type as body from part")
def _(s, d):
    tei = F.concat(F.lit("<entry><title>t</title><p>"), F.col("p_name"), F.lit("</p>\n<p>  <hi>"), F.col("p_type"), F.lit("</hi></p></entry>"))
    return table(s, d, "part").select("p_partkey", H.tei_lines(tei).alias("body"))


@query("d05_utc_stamp", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') as stamp, true as before_now from events")
def _(s, d):
    """Times in the form of the one clock's, which is after all of them."""
    from ..functions.scalars import utc_stamp

    stamp = utc_stamp("ts")
    return table(s, d, "events").select("event_id", stamp.alias("stamp"), (stamp < utc_stamp()).alias("before_now"))


