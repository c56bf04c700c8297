"""Search, the reference grammar and scalar functions as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import scalars as D
from ..functions import text as T
from ..operators import search as S
from ..operators import search_index as X
from . import lens
from .lens import query, table

big = lambda x: x.cast("long")


# ---- full text


@query("f01_query_terms", r"select conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: chr(34) || x || chr(34)), ' ') as match from conversations")
def _(s, d):
    terms = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(terms, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " ").alias("match"))


@query("f02_tokens", "select doc_id, count(*) as n, count(distinct term) as terms from tokens group by doc_id", "tokens")
def _(s, d):
    own = table(s, d, "documents").select("doc_id", S.tokens_of(F.col("text")).alias("own")).where(F.size("own") > 0)
    return own.select("doc_id", F.size("own").cast("long").alias("n"), F.size(F.array_distinct("own")).cast("long").alias("terms"))


@query("f03_porter")
def _(s, d):
    words = table(s, d, "documents").select(F.explode(F.array_distinct(S.tokens_of(F.col("text")))).alias("term")).distinct()
    return words.select("term", S.stem("term").alias("stem"))


# SQL has no stemmer: its forms of a stem are the words of the tables that have it


@query("f04_match_all", "select doc_id from tokens where lang = 'en' group by doc_id having count(*) filter (where term in ('license', 'licensed')) > 0 and count(*) filter (where term = 'under') > 0", "tokens")
def _(s, d):
    found = X.match(lens.index(s, d), "licenses, under!", places_=False)
    return table(s, d, "documents").where("lang = 'en'").select("doc_id").join(found, F.col("doc_id") == F.col("key"), "left_semi")


#: BM25 of two terms in SQL; {a} and {b} are their forms.
BM25_SQL = """per as (select doc_id, count(*) as dl, count(*) filter (where term in ({a})) as t0, count(*) filter (where term in ({b})) as t1 from tokens group by doc_id),
st as (select (select count(*) from documents) as n, sum(dl) / (select count(*) from documents) as mean, count(*) filter (where t0 > 0) as d0, count(*) filter (where t1 > 0) as d1 from per),
idf as (select *, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 0) as r0, greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 0) as r1 from st),
sc as (select doc_id, (case when r0 > 0 then r0 else 1e-6 end) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / mean)) + (case when r1 > 0 then r1 else 1e-6 end) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / mean)) as score from per, idf where t0 > 0 and t1 > 0)"""
_THE, _IN, _ON = "'the', 'thes'", "'in', 'ined', 'ines', 'ining'", "'on', 'one', 'oned', 'ones', 'oning'"


@query("f05_bm25", "with " + BM25_SQL.format(a=_IN, b=_THE) + " select doc_id, round(score, 6) as score from sc", "tokens")
def _(s, d):
    return X.match(lens.index(s, d), "In the", places_=False).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("f06_snippet")
def _(s, d):
    found = X.match(lens.index(s, d), "license under").select(F.col("key").alias("doc_id"), "hits")
    return table(s, d, "documents").select("doc_id", "text").join(found, "doc_id").select("doc_id", X.snippet(F.col("text"), F.col("hits")).alias("snippet"))


@query("f07_limit", "select p_partkey, case when asked is null then 20 when asked between 1 and 100 then asked end as shown, asked is not null and asked not between 1 and 100 as error from (select p_partkey, case when p_size % 5 > 0 then (p_size - 3) * 4 end as asked from part)")
def _(s, d):
    """The limits that requests ask for: none is 20, 1 to 100 are taken, others are errors."""
    asked = F.when(F.col("p_size") % 5 > 0, (F.col("p_size") - 3) * 4)
    low, high = F.lit(S.checked_limit(1)), F.lit(S.checked_limit(100))
    return table(s, d, "part").select("p_partkey", asked.alias("asked")).select("p_partkey", F.when(F.col("asked").isNull(), S.checked_limit()).when(F.col("asked").between(low, high), F.col("asked")).alias("shown"), (F.col("asked").isNotNull() & ~F.coalesce(F.col("asked").between(low, high), F.lit(True))).alias("error"))


# ---- the reference grammar, over references to every book of the tables


#: References to each book, in every form that can be read and every one that cannot; {b} is the book.
_FORMS = ["{b} 4", "{b} 2-4", "{b} 2:1-3:1", "{b} 5:1,2", "{b} 5:1–2", "{b} 11", "{b} 2:0", "{b} 2:2-1", "{b} 4-2", "x{b} 1", "{b}", "{b} 2:x", "{b}. 4:1, 3-2"]


def _lesson_refs(s, d):
    """(book, form, ref) of every book and form."""
    books = lens.lessons(s, d).select("book").distinct()
    forms = F.array(*(F.replace(F.lit(f), F.lit("{b}"), F.initcap("book")) for f in _FORMS))
    return books.select("book", F.posexplode(forms).alias("form", "ref"))


def _lesson_parsed(s, d):
    lessons = lens.lessons(s, d)
    names = lessons.select(F.col("book").alias("alias"), "book").distinct()
    asked = _lesson_refs(s, d).withColumnRenamed("book", "of")
    return R.parse_references(asked, "ref", names, R.bounds_of(lessons))


#: (of, form, spans, display, error) of _FORMS in SQL, from the last verses of chapters 2 to 5.
LESSONS_SQL = """b as (select book, chapter, max(verse_no) as v from lessons group by all),
k as (select book as of, max(chapter) as top, max(v) filter (where chapter = 2) as c2, max(v) filter (where chapter = 3) as c3, max(v) filter (where chapter = 4) as c4, max(v) filter (where chapter = 5) as c5 from b group by book),
f as (select of, 0 as form, case when c4 is null then 'chapter out of range' end as error, '4:1-' || c4 as spans, of || ' 4' as display from k
union all select of, 1, case when c2 is null or c3 is null or c4 is null then 'chapter out of range' end, '2:1-' || c2 || ';3:1-' || c3 || ';4:1-' || c4, of || ' 2-4' from k
union all select of, 2, case when c2 is null or c3 is null then 'chapter out of range' end, '2:1-' || c2 || ';3:1-1', of || case when c3 = 1 then ' 2-3' else ' 2:1-3:1' end from k
union all select of, 3, case when c5 is null then 'chapter out of range' when c5 < 2 then 'verse out of range' end, '5:1-1;5:2-2', of || ' 5:1,2' from k
union all select of, 4, case when c5 is null then 'chapter out of range' when c5 < 2 then 'verse out of range' end, '5:1-2', of || case when c5 = 2 then ' 5' else ' 5:1-2' end from k
union all select of, 5, 'chapter out of range', null, null from k
union all select of, 6, case when c2 is null then 'chapter out of range' else 'verse out of range' end, null, null from k
union all select of, 7, case when c2 is null then 'chapter out of range' when c2 < 2 then 'verse out of range' else 'inverted' end, null, null from k
union all select of, 8, case when top < 4 then 'chapter out of range' else 'inverted' end, null, null from k
union all select of, 9, 'unknown book', null, null from k
union all select of, 10, 'unreadable', null, null from k
union all select of, 11, 'unreadable', null, null from k
union all select of, 12, case when c4 is null then 'chapter out of range' when c4 < 3 then 'verse out of range' else 'inverted' end, null, null from k)"""


@query("g01_resolve_book", """with r as (select distinct l_partkey % 6 as form, l_partkey % 73 as nth from lineitem),
n as (select list_transform(string_split('{names}', '|'), lambda x: x) as names)
select form, nth, case when form = 5 then '' else names[cast(nth + 1 as int)] end as book from r, n""".replace("{names}", "|".join(R.books())))
def _(s, d):
    """Names of books that the table's numbers pick, in six writings of which the last is no name."""
    picked = table(s, d, "lineitem").select((F.col("l_partkey") % 6).alias("form"), (F.col("l_partkey") % 73).alias("nth")).distinct()
    name = F.element_at(F.lit(R.books()), (F.col("nth") + 1).cast("int"))
    numeral = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^3 ", "III "), "^2 ", "ii "), "^1 ", "I ")
    ordinal = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^3 ", "3rd "), "^2 ", "2nd "), "^1 ", "1st ")
    raw = F.when(F.col("form") == 0, F.upper(name)).when(F.col("form") == 1, F.regexp_replace(name, "^([123]) ", "$1")).when(F.col("form") == 2, numeral).when(F.col("form") == 3, ordinal)
    raw = raw.when(F.col("form") == 4, F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("  ")), F.lit(". "))).otherwise(F.concat(F.lit("x"), name))
    return R.resolve_books(picked.withColumn("raw", raw), "raw", R.aliases(s)).select("form", "nth", F.coalesce("book", F.lit("")).alias("book"))


@query("g02_parse", "with " + LESSONS_SQL + " select of, form, coalesce(error, spans) as spans from f", "units lessons")
def _(s, d):
    text = F.array_join(F.transform("spans", lambda x: F.format_string("%d:%d-%d", x["ch"], x["vs"], x["ve"])), ";")
    return _lesson_parsed(s, d).select("of", "form", F.coalesce("error", text).alias("spans"))


@query("g04_display", "with " + LESSONS_SQL + " select of, form, coalesce(error, display) as shown from f", "units lessons")
def _(s, d):
    return _lesson_parsed(s, d).select("of", "form", F.coalesce("error", "display").alias("shown"))


@query("g06_range_display", """select id, case when sv = 0 and ev = 0 then 'B ' || sc || (case when sc = ec then '' else '-' || ec end) when sc = ec and sv = ev then 'B ' || sc || ':' || sv when sc = ec then 'B ' || sc || ':' || sv || '-' || ev else 'B ' || sc || ':' || sv || '-' || ec || ':' || ev end as shown from notes""", "notes")
def _(s, d):
    return lens.notes(s, d).select("id", R.range_display(F.lit("B"), "sc", "sv", "ec", "ev").alias("shown"))


@query("g07_contextual_refs", """with b as (select book, chapter, max(verse_no) as v from lessons group by all), k as (select distinct book, book_order from lessons),
n as (select k.book, coalesce(x.book, k.book) as nx from k left join k x on x.book_order = k.book_order + 1),
p as (select book as of, 0 as part_ix, book as ref_book, 3 as ref_chapter, unnest([1, 9000]) as ref_verse from n
union all select book, 1, nx, 5, unnest([1, 2]) from n union all select book, 2, nx, 5, 2 from n union all select book, 3, book, null, null from n)
select p.of, p.part_ix, p.ref_book, coalesce(p.ref_chapter, -1) as ref_chapter, coalesce(p.ref_verse, -1) as ref_verse, case when p.ref_verse is null then 'chapter only' when b.v >= p.ref_verse then 'ok' else 'invalid' end as outcome
from p left join b on b.book = p.ref_book and b.chapter = p.ref_chapter""", "units lessons")
def _(s, d):
    """Lists whose parts take book and chapter from the ones before; the second book is the next of the canon."""
    lessons = lens.lessons(s, d)
    books = lessons.select("book", "book_order").distinct()
    nx = books.select(F.col("book").alias("nx"), (F.col("book_order") - 1).alias("book_order"))
    named = books.join(nx, "book_order", "left").withColumn("nx", F.coalesce("nx", "book"))
    refs = F.concat(F.lit("3:1,9000; "), F.initcap("nx"), F.lit(" 5:2-1;2. ; "), F.col("book"), F.lit(" 7"))
    asked = named.select(F.col("book").alias("of"), refs.alias("refs"), F.col("book").alias("cur_book"), F.lit(1).alias("cur_chapter"))
    out = R.contextual_refs(asked, "refs", lessons.select(F.col("book").alias("alias"), "book").distinct(), R.bounds_of(lessons))
    return out.select("of", "part_ix", "ref_book", F.when(F.col("outcome") == "chapter only", -1).otherwise(F.col("ref_chapter")).alias("ref_chapter"), F.coalesce("ref_verse", F.lit(-1)).alias("ref_verse"), "outcome")


@query("g09_anchor_forms", """select p_partkey, case p_partkey % 4 when 0 then p_brand || ' ' || p_size || ':5; ' || p_brand || ' ' || p_size || ':7' when 1 then 'Jude 1:' || p_size when 2 then p_brand || ' ' || p_size || ':7' else p_brand || ' 1:1; Jude 1:' || p_size end as refs from part""")
def _(s, d):
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(brand, F.lit(" "), size, F.lit(":5, 7"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Jude "), size))
    raw = raw.when(F.col("p_partkey") % 4 == 2, F.concat(brand, F.lit(" "), size, F.lit(":7."))).otherwise(F.concat(brand, F.lit(" 1:1; Jude "), size))
    return table(s, d, "part").select("p_partkey", R.normal_anchors(raw, ["Jude", "Obadiah"]).alias("refs"))


@query("g10_skip_unreadable", "with " + LESSONS_SQL + " select of, string_agg(display, '; ' order by form) as shown from f where error is null group by of", "units lessons")
def _(s, d):
    """Each book's list of references, with those left out that cannot be read."""
    good = _lesson_parsed(s, d).where("error is null").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("form", "display"))).alias("all"))
    return good.select("of", F.array_join(F.transform("all", lambda x: x["display"]), "; ").alias("shown"))


@query("g11_lexicon_number", "select id, 'H' || cast(cast(substr(number, 2) as int) as varchar) as base from lex", "lex")
def _(s, d):
    return lens.lex(s, d).select("id", R.lexicon_number(F.concat(F.lit(" "), F.lower("number"), F.lit(" "))).alias("base"))


@query("g12_roman", """with p as (select p_partkey, p_partkey % 3999 + 1 as n from part)
select p_partkey, case when p_partkey % 5 = 0 then -1 else n end as n from p""")
def _(s, d):
    """Numbers of the table written in roman digits and read again; every fifth spoilt by another letter."""
    part = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 3999 + 1).alias("n"))
    digit = lambda place, ones: F.element_at(F.lit(["", *(p.translate(str.maketrans("ivx", ones)) for p in "i ii iii iv v vi vii viii ix".split())]), (F.floor(F.col("n") / place) % 10 + 1).cast("int"))
    raw = F.concat(F.repeat(F.lit("M"), F.floor(F.col("n") / 1000).cast("int")), digit(100, "cdm"), digit(10, "xlc"), digit(1, "ivx"), F.when(F.col("p_partkey") % 5 == 0, "a").otherwise(""))
    return part.select("p_partkey", F.coalesce(R.roman(raw), F.lit(-1)).cast("long").alias("n"))


@query("g15_remap", r"select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey % 7 else o_orderkey % 5 end as ch, greatest(1, case when o_orderkey % 3 = 0 then o_orderkey % 4 else o_orderkey % 6 end) as v from orders")
def _(s, d):
    """A bracketed address wins over the plain one before it, and verse 0 becomes 1."""
    k = F.col("o_orderkey")
    raw = F.concat((k % 5).cast("string"), F.lit("."), (k % 6).cast("string"), F.when(k % 3 == 0, F.format_string("[%d.%d]", k % 7, k % 4)).otherwise(""))
    pick = lambda g: F.coalesce(F.nullif(F.regexp_extract("raw", r"\[(\d+)\.(\d+)\]", g), F.lit("")), F.regexp_extract("raw", r"^(\d+)\.(\d+)", g)).cast("long")
    return table(s, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", pick(1).alias("ch"), F.greatest(F.lit(1), pick(2)).alias("v"))


# ---- strings and markup


@query("x01_excerpt", "select doc_id, case when length(text) <= 600 then text else regexp_replace(substring(text, 1, 600), ' [^ ]*$', '') || '...' end as excerpt, length(text) > 600 as truncated from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.cut_at_word("text", 600).alias("excerpt"), T.is_cut("text", 600).alias("truncated"))


@query("x02_cut_words", "select doc_id, case when length(text) <= 250 then text else regexp_replace(substring(text, 1, 250), ' [^ ]*$', '') || '...' end as cut from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.cut_at_word("text", 250).alias("cut"))


@query("x03_zero_pad", "select id, 'H' || cast(cast(substr(number, 2) as int) as varchar) as base from lex", "lex")
def _(s, d):
    return lens.lex(s, d).select("id", T.drop_zero_pad("number").alias("base"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("x04_keywords", f"""with t as (select conv_id, turn, unnest(l) as w, unnest(range(1, len(l) + 1)) as pos from (select conv_id, turn, string_split_regex(lower(text), '[^a-z]+') as l from conversations)),
f as (select conv_id, turn, w, min(pos) as pos from t where w <> '' and w not in ({_STOP}) group by all), g as (select conv_id, turn, string_agg(w, ' ' order by pos) as keywords from f group by all)
select c.conv_id, c.turn, coalesce(g.keywords, '') as keywords from conversations c left join g on g.conv_id = c.conv_id and g.turn = c.turn""")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(T.keywords("text"), " ").alias("keywords"))


_WS = "[ \\t\\r\\n\\f\\x0B]+"


@query("x05_squeeze", f"select doc_id, md5(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) as h from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.squeeze("text")).alias("h"))


@query("x06_markers", rf"""select doc_id, md5(trim(regexp_replace(replace(regexp_replace('\p ' || text || ' \f* |', '\\[a-zA-Z]+[0-9]*\*?', '', 'g'), '|', ''), '{_WS}', ' ', 'g'))) as h from documents""")
def _(s, d):
    marked = F.concat(F.lit("\\p "), F.col("text"), F.lit(" \\f* |"))
    return table(s, d, "documents").select("doc_id", F.md5(T.strip_backslash_markers(marked)).alias("h"))


_ENT = "replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&mdash;', '\u2014'), '&ndash;', '\u2013'), '&amp;', '&')"


@query("x07_unwrap", "select page_id, md5(trim(regexp_replace(" + _ENT.format("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script(?: [^>]*)?>.*?</script>', ' ', 'g'), '(?s)<style(?: [^>]*)?>.*?</style>', ' ', 'g'), '<[^>]+>', '', 'g')") + f", '{_WS}', ' ', 'g'))) as h from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.unwrap_markup("html", ("script", "style"))).alias("h"))


@query("x08_html_text")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.html_text("html").alias("text"))


@query("x09_paragraphs")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.posexplode(T.paragraphs("html")).alias("at", "paragraph"))


@query("x10_strip_tags", "select page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(" + _ENT.format("regexp_replace(html, '<[^>]+>', '', 'g')") + r", chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) as h from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.strip_tags("html")).alias("h"))


@query("x12_unescape")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.unescape_all("html")).alias("h"))


_MEND_SQL = """with b as (select doc_id, replace(replace(replace(replace(text, ' ', chr(160)), ',', chr(226) || chr(128) || chr(153)), '.', chr(226) || chr(128) || chr(166)), '-', chr(151)) as x from documents)
select doc_id, md5(translate(%s, '%s' || chr(160), '%s ')) as h from b"""


def _mended(x: str) -> str:
    """DuckDB form of the runs of three characters, one inside the other."""
    for last, mark in ((152, 8216), (153, 8217), (156, 8220), (157, 8221), (147, 8211), (148, 8212), (166, 8230)):
        x = f"replace({x}, chr(226) || chr(128) || chr({last}), chr({mark}))"
    return x


@query("x13_mend", _MEND_SQL % (_mended("x"), "".join(T.CONTROL_MARKS), "".join(T.CONTROL_MARKS.values())))
def _(s, d):
    """Every text, broken as if read in the wrong code page: blanks, commas, full stops and hyphens; what was broken before is mended too."""
    x = F.col("text")
    for char, broken in ((" ", "\u00a0"), (",", "\u00e2\x80\x99"), (".", "\u00e2\x80\u00a6"), ("-", "\x97")):
        x = F.replace(x, F.lit(char), F.lit(broken))
    return table(s, d, "documents").select("doc_id", F.md5(T.mend_encoding(x)).alias("h"))


@query("x14_letters_key", "select p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') as k from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.letters_key("p_name").alias("k"))


@query("x15_plain_words", "select conv_id, turn, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> ''), ' ') as words from conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(T.plain_words("text"), " ").alias("words"))


@query("x16_tail_fragment", """with t as (select p_partkey, regexp_replace(upper(right(p_name, cast(p_size % 8 as int))), '[^A-Z]', '', 'g') as t, upper(split_part(p_name, ' ', 2)) as last from part)
select p_partkey, len(t) >= 2 and len(t) * 2 <= len(last) and ends_with(last, t) and t <> last as tail from t""")
def _(s, d):
    term = F.concat(F.upper(F.right("p_name", (F.col("p_size") % 8).cast("int"))), F.lit("."))
    return table(s, d, "part").select("p_partkey", T.is_tail_of(term, F.concat(F.lit("see "), F.upper("p_name"), F.lit("."))).alias("tail"))


@query("x17_remark", r"select conv_id, turn, (len(string_split(text, ' ')) > 30 or contains(text, chr(10)) or regexp_matches(text, '\b(Heb|Gr|Chald|Sept|Vulg|Syr|Arab|Targum|A\.M\.|B\.C\.|An\. Ex\.|i\.e\.|viz\.)\b') or (regexp_matches(text, '^[0-9. \tA-Za-z,;]+$') and regexp_matches(text, '[0-9]{3,}'))) as remark from conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.is_remark("text", F.split("text", " ")).alias("remark"))


@query("x18_word_sound", "select s_suppkey, 'w' || s_suppkey as word, s_name as sound from supplier")
def _(s, d):
    cell = F.concat(F.lit("w"), F.col("s_suppkey").cast("string"), F.lit(" ("), F.col("s_name"), F.lit(")"))
    word, sound = T.word_and_sound(cell)
    return table(s, d, "supplier").select("s_suppkey", word.alias("word"), sound.alias("sound"))


@query("x19_base_numbers", "select p_partkey, case p_partkey % 4 when 0 then 'H' || n when 1 then 'H' || n || ', G' || k when 2 then 'G' || n else 'H' || k end as base from formed", "formed")
def _(s, d):
    forms = [F.format_string("H%dG", "n"), F.format_string("H%d_A, G%d", "n", "k"), F.format_string("G%d", "n"), F.format_string(" , H%d_b", "k")]
    return lens.formed(s, d, *forms).select("p_partkey", T.base_numbers("raw").alias("base"))


@query("x20_split_once", "select p_partkey, split_part(p_type, ' ', 1) as head, case when instr(p_type, ' ') = 0 then '' else substr(p_type, instr(p_type, ' ') + 1) end as rest from part")
def _(s, d):
    head, rest = T.split_first("p_type", " ")
    return table(s, d, "part").select("p_partkey", head.alias("head"), rest.alias("rest"))


@query("x21_corrections", "select p_partkey, replace(replace(p_type, 'STEEL', 'IRON'), 'IRON', 'TIN') as fixed from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.correct("p_type", [("STEEL", "IRON"), ("IRON", "TIN")]).alias("fixed"))


@query("x22_dehyphenate", """select p_partkey, case p_partkey % 5 when 0 then w1 || upper(w2) when 1 then k || ':' || n || '-' || k || '.' when 2 then w1 || '—' || w2 when 3 then w1 || '—' || chr(10) || upper(w2) else w1 || '- ' || w2 end as joined from formed""", "formed")
def _(s, d):
    forms = [F.format_string("%s-\n\n%s", "w1", F.upper("w2")), F.format_string("%d:%d-\n%d.", "k", "n", "k"), F.format_string("%s—\n%s", "w1", "w2"), F.format_string("%s—\n%s", "w1", F.upper("w2")), F.format_string("%s- %s", "w1", "w2")]
    return lens.formed(s, d, *forms).select("p_partkey", T.join_hyphenated("raw").alias("joined"))


@query("x23_furniture", "select p_partkey, p_partkey % 6 < 4 as furniture from formed", "formed")
def _(s, d):
    forms = [F.format_string("%d", "n"), F.format_string("  %d THE %s", "n", F.upper("w2")), F.format_string("%s. %d", F.upper("w1"), "n"), F.repeat(F.lit("- "), F.col("k").cast("int")), F.format_string("In the %s %d", "w1", "n"), F.format_string("%d in the %s", "n", "w2")]
    return lens.formed(s, d, *forms).select("p_partkey", T.is_furniture("raw").alias("furniture"))


@query("x24_footer", r"""with f as (select doc_id, string_split(text || chr(10) || chr(10) || '____' || chr(10) || case when doc_id % 3 = 0 then '2 S A M' else 'S A M' end || chr(10), chr(10)) as l from documents),
k as (select doc_id, l, list_max(list_filter(range(1, len(l) + 1), lambda i: i = 1 or not regexp_full_match(l[i], '[ \t]*(_+|[A-Z]( [A-Z])+)?[ \t]*'))) as n from f)
select doc_id, md5(trim(array_to_string(l[1:n], chr(10)))) as h from k""")
def _(s, d):
    """Every text with a footer behind it, also those that end like one; every third footer has a digit and is none."""
    footer = F.concat(F.lit("\n\n____\n"), F.when(F.col("doc_id") % 3 == 0, "2 S A M\n").otherwise("S A M\n"))
    return table(s, d, "documents").select("doc_id", F.md5(T.strip_footer(F.concat("text", footer))).alias("h"))


@query("x25_cut_clean", "select doc_id, regexp_replace(substring(text, 1, 40), '[ \\t\\r\\n\u2014\u2013\u00b7.-]+$', '') as cut from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.cut_clean("text", 40).alias("cut"))


@query("x26_wikitext", "select n_nationkey, 'x ' || n_name || ' i' as text from nation")
def _(s, d):
    wiki = F.concat(F.lit("{{a|{{b|x}}}} [[t|"), F.col("n_name"), F.lit("]] ''i''<ref>r</ref>"))
    return table(s, d, "nation").select("n_nationkey", T.wiki_text(wiki).alias("text"))


@query("x27_spaced_capitals", "select p_partkey, case p_partkey % 3 when 0 then 'of ' || upper(w1) || ' now' when 1 then 'A B ' || w2 else upper(w2) || ' and ' || upper(w1) end as joined from formed", "formed")
def _(s, d):
    spaced = lambda w: F.array_join(F.split(F.upper(w), ""), " ")
    forms = [F.format_string("of %s now", spaced("w1")), F.format_string("A B %s", "w2"), F.format_string("%s and %s", spaced("w2"), spaced("w1"))]
    return lens.formed(s, d, *forms).select("p_partkey", T.join_spaced_capitals("raw").alias("joined"))


@query("x28_prefix", "select c_custkey, split_part(c_name, '#', 1) as prefix from customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", T.before("c_name", "#").alias("prefix"))


@query("x29_with_title", "select p_partkey, case when p_partkey % 3 = 0 then p_type else p_brand || chr(10) || chr(10) || p_type end as body from part")
def _(s, d):
    title = F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", T.with_title(title, "p_type").alias("body"))


@query("x30_count_matches", "select doc_id, len(regexp_extract_all(text, '[0-9]+')) as n from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.count_matches("text", "[0-9]+").alias("n"))


# ---- dates, digits, hashes, arrays


@query("d01_iso_date", "select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') else 'invalid' end as day from orders")
def _(s, d):
    """Dates of the table; three of four spoilt: a day too many, no hyphens, blanks."""
    at = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, at("yyyy-MM-dd")).when(k == 1, F.concat(at("yyyy-MM"), F.lit("-32"))).when(k == 2, at("yyyyMMdd")).otherwise(F.concat(at("yyyy-MM-dd"), F.lit(" x")))
    return table(s, d, "orders").select("o_orderkey", F.coalesce(D.iso_date(raw).cast("string"), F.lit("invalid")).alias("day"))


@query("d02_plan_day", "select o_orderkey, date_diff('day', date '1997-01-01', cast(o_orderdate as date)) + 1 as day, case when date_diff('day', date '1997-01-01', cast(o_orderdate as date)) + 1 < 1 then 'not begun' when date_diff('day', date '1997-01-01', cast(o_orderdate as date)) + 1 > 365 then 'finished' else 'active' end as status from orders")
def _(s, d):
    day, status = D.plan_day(F.lit("1997-01-01").cast("date"), F.col("o_orderdate").cast("date"), 365)
    return table(s, d, "orders").select("o_orderkey", big(day).alias("day"), status.alias("status"))


_DOY = "dayofyear({0}) + case when month({0}) > 2 and not (year({0}) % 4 = 0 and (year({0}) % 100 <> 0 or year({0}) % 400 = 0)) then 1 else 0 end"


@query("d03_leap_doy", f"select cast(l_shipdate as date)::varchar as day, {_DOY.format('l_shipdate')} as n from (select distinct l_shipdate from lineitem)")
def _(s, d):
    days = table(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return days.select(F.col("day").cast("string"), big(D.leap_day_of_year("day")).alias("n"))


@query("d04_month_day", "select distinct month(l_shipdate) as m, day(l_shipdate) as dd, dayofyear(make_date(2024, month(l_shipdate), day(l_shipdate))) as n from lineitem")
def _(s, d):
    days = table(s, d, "lineitem").select(big(F.month("l_shipdate")).alias("m"), big(F.dayofmonth("l_shipdate")).alias("dd")).distinct()
    return days.select("m", "dd", big(D.month_day_number(F.col("m").cast("int"), F.col("dd").cast("int"))).alias("n"))


@query("d06_month_name", "select o_orderkey, cast(case o_orderkey % 4 when 2 then -1 when 3 then -1 else dayofyear(make_date(2024, month(o_orderdate), day(o_orderdate))) end as int) as n from orders")
def _(s, d):
    """Days of the table as month and day, in small or other letters; half spoilt: a day or a month that there is not."""
    name, day, k = F.date_format("o_orderdate", "MMMM"), F.dayofmonth("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat_ws("-", F.lower(name), day)).when(k == 1, F.concat_ws("-", name, day)).when(k == 2, F.concat_ws("-", name, F.lit("32"))).otherwise(F.concat_ws("-", F.lit("x"), day))
    return table(s, d, "orders").select("o_orderkey", F.coalesce(D.month_name_key(raw), F.lit(-1)).alias("n"))


@query("m01_hash_modulo", """select n_name, list_reduce(list_prepend(0::bigint, list_transform(range(1, 65), lambda i: cast(instr('0123456789abcdef', substr(sha256(n_name), cast(i as int), 1)) - 1 as bigint))), lambda a, b: (a * 16 + b) % 31102) as at from nation""")
def _(s, d):
    return table(s, d, "nation").select("n_name", D.hash_modulo("n_name", F.lit(31102)).alias("at"))


@query("m03_even_sizes", "select source, array_to_string(list_transform(range(0, 7), lambda i: n // 7 + (case when i < n % 7 then 1 else 0 end)), ',') as sizes from (select source, count(*) as n from documents group by source)")
def _(s, d):
    per = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return per.select("source", F.array_join(F.transform(D.even_sizes("n", 7), lambda x: x.cast("string")), ",").alias("sizes"))


@query("m04_similarity")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.round(D.similarity("p_name", "p_type"), 6).alias("ratio"))


@query("m05_digit_diffs", """select a.p_partkey, coalesce(case when length(a.p_partkey::varchar) = length((a.p_partkey + 9)::varchar) then len(list_filter(range(1, length(a.p_partkey::varchar) + 1), lambda i: substr(a.p_partkey::varchar, cast(i as int), 1) <> substr((a.p_partkey + 9)::varchar, cast(i as int), 1))) end, -1) as n from part a""")
def _(s, d):
    a, b = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 9).cast("string")
    return table(s, d, "part").select("p_partkey", big(F.coalesce(D.digit_differences(a, b), F.lit(-1))).alias("n"))


@query("m06_confusion", """with e as (select p_partkey, cast(p_partkey + 100 as varchar) as e from part), c as (select *, len(e) - len(replace(replace(e, '1', ''), '0', '')) as swapped from e)
select p_partkey, cast(case p_partkey % 4 when 0 then 0 when 1 then case when swapped <= 2 then swapped else -1 end else -1 end as int) as subs from c""")
def _(s, d):
    """Numbers as they are, with l and O for 1 and 0, without their last digit, and with a letter that is taken for none."""
    e, k = (F.col("p_partkey") + 100).cast("string"), F.col("p_partkey") % 4
    token = F.when(k == 0, e).when(k == 1, F.translate(e, "10", "lO")).when(k == 2, F.left(e, F.length(e) - 1)).otherwise(F.concat(F.lit("x"), F.substring(e, F.lit(2), F.length(e))))
    return table(s, d, "part").select("p_partkey", F.coalesce(D.confusion_substitutions(token, e), F.lit(-1)).alias("subs"))


@query("n01_split_explode", "select p_partkey, unnest(string_split(p_type, ' ')) as part from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("part"))


@query("n02_ordered_unique", "select conv_id, string_agg(role, ',' order by first) as roles from (select conv_id, role, min(turn) as first from conversations group by all) group by conv_id")
def _(s, d):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(roles), ",").alias("roles"))


@query("n03_map_with_nulls", "select book, 'de=' || coalesce(cast(count(*) filter (where translation = 'de') as varchar), '') || ',en=' || cast(count(*) filter (where translation = 'en') as varchar) as per from units group by book", "units")
def _(s, d):
    per = lens.units(s, d).groupBy("book").agg(F.count_if(F.col("translation") == "de").alias("de"), F.count_if(F.col("translation") == "en").alias("en"))
    as_map = F.map_from_arrays(F.array(F.lit("de"), F.lit("en")), F.array("de", "en"))
    return per.select("book", F.array_join(F.transform(F.map_entries(as_map), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("per"))


@query("n04_nested_json", """select conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' order by turn, role) || ']' as js from conversations group by conv_id""")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("js"))


@query("n05_slice_total", "select head, array_to_string(list_slice(list(distinct ref order by ref), 1, 3), ',') as first, count(distinct ref) as total from edges group by head", "edges")
def _(s, d):
    refs = F.array_sort(F.collect_set("ref"))
    per = lens.edges(s, d).groupBy("head").agg(refs.alias("refs"))
    return per.select("head", F.array_join(F.transform(F.slice("refs", 1, 3), lambda x: x.cast("string")), ",").alias("first"), big(F.size("refs")).alias("total"))


@query("n06_longest_prefix", "select p_partkey, cast(([2, 1, 0, 2])[p_partkey % 4 + 1] as int) as n from part")
def _(s, d):
    """How many first words of ``w1 w2 end`` stand in a row in other texts."""
    within = [F.format_string("x %s %s y", "w1", "w2"), F.format_string("x %s y", "w1"), F.format_string("x %s y", "w2"), F.format_string("%s y %s %s", "w1", "w1", "w2")]
    words = F.array("w1", "w2", F.lit("end"))
    return lens.formed(s, d, *within).select("p_partkey", D.longest_prefix(words, F.split("raw", " ")).alias("n"))


@query("n07_subsequence", "select p_partkey, (['strong', 'weak', 'none', 'none'])[p_partkey % 4 + 1] as strength from part")
def _(s, d):
    """Words in their order, with one that is absent, with two, and in another order."""
    words = [F.format_string("%s %s", "w1", "w2"), F.format_string("%s zz %s", "w1", "w2"), F.format_string("%s zz qq", "w1"), F.format_string("%s %s", "w2", "w1")]
    within = F.array(F.lit("x"), F.col("w1"), F.lit("y"), F.col("w2"))
    return lens.formed(s, d, *words).select("p_partkey", D.match_strength(F.split("raw", " "), within).alias("strength"))


@query("n08_format", "select o_orderkey, o_orderpriority || ' ' || o_custkey || ':' || (o_orderkey % 9) as shown from orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.format_string("%s %d:%d", "o_orderpriority", "o_custkey", F.col("o_orderkey") % 9).alias("shown"))
