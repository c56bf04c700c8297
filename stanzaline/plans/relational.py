"""Projections, predicates, joins, aggregations, sorts and set operations as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import patterns as M
from ..operators import number_sets as N
from . import lens
from .lens import query, table

big = lambda x: x.cast("long")


# ---- scans and projections


@query("s01_scan", "select r_regionkey, r_name from region")
def _(s, d):
    return table(s, d, "region").select("r_regionkey", "r_name")


@query("p01_key_filter", "select chapter, verse_no, text from units where translation = (select lang from documents where doc_id = 3) and book = 'src3' and chapter = 3", "units")
def _(s, d):
    """Three keys; the third document's language is read first, as a caller has it."""
    own = table(s, d, "documents").where("doc_id = 3").select("lang").first()
    return lens.units(s, d).where((F.col("translation") == (own["lang"] if own else None)) & (F.col("book") == "src3") & (F.col("chapter") == 3)).select("chapter", "verse_no", "text")


@query("p02_verse_range", "select translation, chapter, verse_no, text from units where verse_no between 2 and 4", "units")
def _(s, d):
    return lens.units(s, d).where(F.col("verse_no").between(2, 4)).select("translation", "chapter", "verse_no", "text")


@query("p03_containment", """select id from notes where ((sc < 2) or (sc = 2 and (sv = 0 or sv <= 3))) and ((ec > 2) or (ec = 2 and (ev = 0 or ev >= 3)))""", "notes")
def _(s, d):
    return lens.notes(s, d).where(J.covers(F.lit(2), F.lit(3))).select("id")


@query("p04_optional_source", "select id, 'Brand#13' as asked from notes where source_id = 'Brand#13' union all select id, 'any' from notes", "notes")
def _(s, d):
    notes = lens.notes(s, d)

    def of(source):
        return notes.where(F.lit(True) if source is None else F.col("source_id") == source).select("id", F.lit(source or "any").alias("asked"))

    return of("Brand#13").unionByName(of(None))


@query("p05_caseless_equal", "select p_partkey, p_brand from part where lower(p_brand) = lower('bRAND#13')")
def _(s, d):
    return table(s, d, "part").where(F.lower("p_brand") == "brand#13").select("p_partkey", "p_brand")


@query("p06_norm_key", "select id, substr(number, 1, 1) || cast(cast(substr(number, 2) as int) as varchar) as base from lex where cast(substr(number, 2) as int) = 7", "lex")
def _(s, d):
    return lens.lex(s, d).select("id", T.drop_zero_pad("number").alias("base")).where("base = 'H7'")


@query("p07_in_list", "select id, source_id from notes where source_id in ('Brand#11', 'Brand#12', 'Brand#55')", "notes")
def _(s, d):
    return lens.notes(s, d).where(F.col("source_id").isin("Brand#11", "Brand#12", "Brand#55")).select("id", "source_id")


@query("p08_flag", "select doc_id, count(*) as n from words where is_variant = 0 group by doc_id", "words")
def _(s, d):
    return lens.words(s, d).where("is_variant = 0").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("p09_blank", "select count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) where line is null or trim(line) = ''")
def _(s, d):
    lines = table(s, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.where(F.col("line").isNull() | (F.trim("line") == "")).agg(F.count("*").alias("n"))


@query("p10_like", r"select o_orderkey from orders where o_orderpriority like '_-%' and not o_orderpriority like '5\%-%' escape '\'")
def _(s, d):
    return table(s, d, "orders").where(r"o_orderpriority like '_-%' and not o_orderpriority like '5!%-%' escape '!'").select("o_orderkey")


@query("p11_regex", "select doc_id from documents where regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def _(s, d):
    return table(s, d, "documents").where(F.col("text").rlike("[0-9]{3}-[0-9]{4}")).select("doc_id")


@query("p12_array_member", "select doc_id from documents where list_contains(regexp_extract_all(lower(text), '[a-z]+'), 'license')")
def _(s, d):
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(s, d, "documents").where(F.array_contains(found, "license")).select("doc_id")


@query("p13_inverted", "select id, sc + 2 as sc, sv, ec, ev from notes where ev <> 0 and (sc + 2 > ec or (sc + 2 = ec and sv > ev)) and id % 3 = 0", "notes")
def _(s, d):
    """Of ranges, a third of whose starts are two chapters late, those that end before they begin."""
    late = lens.notes(s, d).withColumn("sc", F.col("sc") + F.when(F.col("id") % 3 == 0, 2).otherwise(0))
    return late.where("ev <> 0 and (sc > ec or (sc = ec and sv > ev))").select("id", "sc", "sv", "ec", "ev")


@query("p14_in_bounds", """with b as (select book_order, chapter, max(verse_no) as top from units group by all)
select k.chapter, k.v, (b.top is not null and k.v between 1 and b.top) as valid
from (select distinct l_partkey % 300 as chapter, l_linenumber as v, l_partkey % 300 % 20 as bo from lineitem) k left join b on b.book_order = k.bo and b.chapter = k.chapter""", "units")
def _(s, d):
    tops = lens.units(s, d).groupBy("book_order", "chapter").agg(F.max("verse_no").alias("top"))
    asked = table(s, d, "lineitem").select((F.col("l_partkey") % 300).alias("chapter"), F.col("l_linenumber").alias("v")).distinct().withColumn("book_order", (F.col("chapter") % 20).cast("int"))
    met = asked.join(tops, ["book_order", "chapter"], "left")
    return met.select("chapter", "v", (F.col("top").isNotNull() & F.coalesce(F.col("v").between(1, F.col("top")), F.lit(False))).alias("valid"))


@query("p15_word_class", """select p_partkey, case when p_size % 2 = 0 then split_part(split_part(p_type, '+', 1), ' ', 1) in ('STANDARD', 'ECONOMY')
 else len(list_filter(string_split(p_type, ' '), lambda x: left(case when starts_with(x, 'P') then substr(x, 2) else x end, 1) in ('B', 'L', 'O'))) > 0 end as key_word from part""")
def _(s, d):
    """A tag before the first mark decides in one testament, any segment's first letter (one prefix letter off) in the other."""
    head = F.substring_index(F.substring_index("p_type", "+", 1), " ", 1).isin("STANDARD", "ECONOMY")
    segment = F.exists(F.split("p_type", " "), lambda x: F.left(F.when(x.startswith("P"), F.substr(x, F.lit(2))).otherwise(x), F.lit(1)).isin("B", "L", "O"))
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, head).otherwise(segment).alias("key_word"))


@query("p16_reading", "select p_partkey, case when p_size % 2 = 0 then regexp_matches(p_type, '[Nn]') else left(p_type, 1) in ('L', 'S') end as main_reading from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_type").rlike("[Nn]")).otherwise(F.left("p_type", F.lit(1)).isin("L", "S")).alias("main_reading"))


@query("p17_rename_cast", "select book, chapter, try_cast(verse as int) as verse from units", "units")
def _(s, d):
    return lens.units(s, d).select("book", "chapter", F.col("verse").try_cast("int").alias("verse"))


@query("p18_valid_codes", """select a.code, case when t.lang is null then 'unknown code' else '' end as error from (values ('en'), ('de'), ('xx')) a(code)
left join (select distinct lang from documents) t on t.lang = a.code""")
def _(s, d):
    asked = s.createDataFrame([("en",), ("de",), ("xx",)], "code string")
    known = table(s, d, "documents").select(F.col("lang").alias("code"), F.lit(1).alias("known")).distinct()
    return asked.join(known, "code", "left").select("code", F.when(F.col("known").isNull(), "unknown code").otherwise("").alias("error"))


@query("p19_point_lookup", "select a.id, coalesce(p.p_name, 'not found') as name from (values (1), (77), (-5)) a(id) left join part p on p.p_partkey = a.id")
def _(s, d):
    asked = s.createDataFrame([(1,), (77,), (-5,)], "id int")
    p = table(s, d, "part").where(F.col("p_partkey").isin(1, 77, -5))
    return asked.join(p, asked["id"] == p["p_partkey"], "left").select("id", F.coalesce("p_name", F.lit("not found")).alias("name"))


# ---- joins


@query("j01_hit_to_row", "select d.doc_id, d.lang, d.n_chars from documents d join (select distinct doc_id from tokens where term in ('license', 'licensed')) h on h.doc_id = d.doc_id", "tokens")
def _(s, d):
    """Hits of the stored index joined with their rows."""
    from ..operators.search_index import match

    found = match(lens.index(s, d), "licenses", places_=False).select(F.col("key").alias("doc_id"))
    return table(s, d, "documents").select("doc_id", "lang", "n_chars").join(found, "doc_id")


@query("j02_dimension", "select l.office, l.seq, l.speaker from liturgy l join (select distinct role from conversations) e on e.role = l.speaker where l.speaker = 'user'", "liturgy")
def _(s, d):
    editions = table(s, d, "conversations").select(F.col("role").alias("speaker")).distinct()
    return lens.liturgy(s, d).where("speaker = 'user'").join(editions, "speaker").select("office", "seq", "speaker")


@query("j03_source_rights", "select x.id, x.number, s.rights from lex x join lex_src s using (source_id)", "lex lex_src")
def _(s, d):
    return lens.lex(s, d).join(lens.lex_src(s, d), "source_id").select("id", "number", "rights")


@query("j04_left_count", "select s.source_id, count(x.id) as n from lex_src s left join lex x using (source_id) group by s.source_id", "lex lex_src")
def _(s, d):
    return J.with_counts(lens.lex_src(s, d), lens.lex(s, d), "source_id", "id").select("source_id", "n")


_COVER = "((n.sc < k.ch) or (n.sc = k.ch and (n.sv = 0 or n.sv <= k.v))) and ((n.ec > k.ch) or (n.ec = k.ch and (n.ev = 0 or n.ev >= k.v)))"


@query("j05_interval_cover", f"select k.book_order, k.ch, k.v, n.id from keys k join notes n on n.book_order = k.book_order and {_COVER}", "keys notes")
def _(s, d):
    return J.covering_notes(lens.keys(s, d), lens.notes(s, d)).select("book_order", "ch", "v", "id")


@query("j06_overlap_tier", """with k as (select distinct l_partkey % 50 as ch, cast(l_linenumber as bigint) * 10 as v from lineitem),
m as (select k.ch, k.v, a.dev_id, case when a.vs <= k.v and a.ve >= k.v then 0 else 1 end as tier from k join anchors a on a.ch = k.ch and a.vs <= k.v + 3 and a.ve >= k.v - 3)
select ch, v, dev_id, tier from m qualify tier = min(tier) over (partition by ch, v)""", "anchors")
def _(s, d):
    asked = table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("ch"), (F.col("l_linenumber").cast("long") * 10).alias("v")).distinct()
    return J.overlap_tiers(asked, lens.anchors(s, d)).select("ch", "v", "dev_id", "tier")


@query("j08_compare", """select book, verse_no, coalesce(min(text) filter (where translation = 'en'), '') as en, coalesce(min(text) filter (where translation = 'de'), '') as de, coalesce(min(text) filter (where translation = 'fr'), '') as fr
from units where translation in ('en', 'de', 'fr') group by book, verse_no""", "units")
def _(s, d):
    side = J.side_by_side(lens.units(s, d), ["en", "de", "fr"], ["book", "verse_no"])
    return side.select("book", "verse_no", *(F.coalesce(c, F.lit("")).alias(c) for c in ("en", "de", "fr")))


@query("j09_presence", """select c.code as translation, coalesce(u.text, '') as text, u.text is not null as present from (select distinct lang as code from documents) c
left join (select * from units where chapter = 7 and verse_no = 1) u on u.translation = c.code""", "units")
def _(s, d):
    codes = table(s, d, "documents").select(F.col("lang").alias("translation")).distinct()
    return J.presence(codes, lens.units(s, d), chapter=7, verse_no=1).select("translation", F.coalesce("text", F.lit("")).alias("text"), "present")


@query("j10_target_text", """with e as (select distinct head, ref from edges), t as (select *, row_number() over (partition by head order by ref) as rn from e)
select t.head, t.ref, coalesce(p.p_name, '') as name from t left join part p on p.p_partkey = t.ref where rn <= 8""", "edges")
def _(s, d):
    from ..operators.windows import top_k

    eight = top_k(lens.edges(s, d).select("head", "ref").distinct(), ["head"], ["ref"], 8)
    p = table(s, d, "part").select(F.col("p_partkey").alias("ref"), "p_name")
    return eight.join(p, "ref", "left").select("head", "ref", F.coalesce("p_name", F.lit("")).alias("name"))


@query("j11_edges", "select distinct e.head, e.line, e.ref from edges e join orders o on o.o_orderkey = e.head and e.line = o.o_custkey % 7 + 1 and o.o_orderstatus <> 'O'", "edges")
def _(s, d):
    """The links of the lines that closed orders name, by head and line."""
    asked = table(s, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("head"), (F.col("o_custkey") % 7 + 1).alias("line"))
    return lens.edges(s, d).join(asked, ["head", "line"], "left_semi").select("head", "line", "ref").distinct()


@query("j12_priority", """with k as (select *, list_position(['Brand#13', 'Brand#22', 'Brand#31', 'Brand#44', 'Brand#55'], source_id) as r from lex where list_position(['Brand#13', 'Brand#22', 'Brand#31', 'Brand#44', 'Brand#55'], source_id) > 0)
select number, source_id, definition from k qualify row_number() over (partition by number order by r, id) = 1""", "lex")
def _(s, d):
    order = ["Brand#13", "Brand#22", "Brand#31", "Brand#44", "Brand#55"]
    return J.first_by_priority(lens.lex(s, d), "number", "source_id", order, "definition", "id")


@query("j13_anti", "select distinct e.head, e.ref from edges e where not exists (select 1 from part p where p.p_partkey = e.ref and p.p_size <= 40)", "edges")
def _(s, d):
    """Links whose part is not among those of at most 40."""
    return J.orphans(lens.edges(s, d).select("head", "ref").distinct(), "ref", table(s, d, "part").where("p_size <= 40"), "p_partkey")


@query("j14_key_diff", """with a as (select distinct verse_no, book from units where translation = 'en'), b as (select distinct verse_no, book from units where translation = 'fr')
select book, verse_no, 'left' as side from (select book, verse_no from a except select book, verse_no from b) union all select book, verse_no, 'right' from (select book, verse_no from b except select book, verse_no from a)""", "units")
def _(s, d):
    u = lens.units(s, d)
    return J.key_difference(u.where("translation = 'en'"), u.where("translation = 'fr'"), ["book", "verse_no"])


_TERMS = ["license", "with", "que", "und"]


@query("j15_contains", "select c.conv_id, c.turn, len(list_filter(['license', 'with', 'que', 'und'], lambda k: contains(lower(c.text), k))) as hits from conversations c where len(list_filter(['license', 'with', 'que', 'und'], lambda k: contains(lower(c.text), k))) > 0")
def _(s, d):
    low = F.lower("text")
    hits = sum((low.contains(k).cast("long") for k in _TERMS), F.lit(0).cast("long"))
    return table(s, d, "conversations").select("conv_id", "turn", hits.alias("hits")).where("hits > 0")


def _spoken(s, d):
    """Words of four letters and more of the conversations, and the documents in small letters."""
    said = table(s, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("p"))
    return said.distinct(), table(s, d, "documents").select("doc_id", F.lower("text").alias("low"))


_SPOKEN_SQL = "p as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as p from conversations)"


@query("j15_many_patterns", f"with {_SPOKEN_SQL}, w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) select p as pattern, count(distinct doc_id) as n_texts, count(*) as n_hits from w join p on p = w group by p")
def _(s, d):
    """All words of one table as patterns over the texts of another: one automaton, no pairs of patterns and texts."""
    patterns, docs = _spoken(s, d)
    return M.counts(docs, "low", patterns, "p", inside=M.LETTERS)


@query("j15_pattern_hits", f"with {_SPOKEN_SQL}, w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) select doc_id, count(*) as n_hits, count(distinct p) as n_patterns, cast(sum(length(p)) as bigint) as covered from w join p on p = w group by doc_id")
def _(s, d):
    """The places of the same patterns, by document."""
    patterns, docs = _spoken(s, d)
    found = M.hits(docs, "doc_id", "low", patterns, "p", inside=M.LETTERS)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.count_distinct("pattern").alias("n_patterns"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("covered"))


@query("j16_zip", """with a as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'user'),
b as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'assistant')
select conv_id, n, coalesce(a.turn, -1) as asked, coalesce(b.turn, -1) as answered from a full join b using (conv_id, n)""")
def _(s, d):
    c = table(s, d, "conversations")
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", F.col("turn").alias(name))
    met = J.zip_by_order(side("user", "asked"), side("assistant", "answered"), "conv_id", "asked", "answered")
    return met.select("conv_id", big(F.col("n")).alias("n"), F.coalesce("asked", F.lit(-1)).alias("asked"), F.coalesce("answered", F.lit(-1)).alias("answered"))


@query("j17_index_payload", "select l.l_orderkey, count(*) as n, cast(sum(case when o.o_orderkey is null then 1 else 0 end) as bigint) as lost from lineitem l left join orders o on o.o_orderkey = l.l_orderkey group by l.l_orderkey")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("there"))
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return lines.join(o, "l_orderkey", "left").select("l_orderkey", "n", F.when(F.col("there").isNull(), F.col("n")).otherwise(0).alias("lost"))


@query("j18_code_names", "select n_name, r_name from nation join region on r_regionkey = n_regionkey")
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name")


# ---- aggregations


@query("a01_count", "select count(*) as n from units", "units")
def _(s, d):
    return lens.units(s, d).agg(F.count("*").alias("n"))


@query("a02_group_count", "select translation, count(*) as n from units group by translation", "units")
def _(s, d):
    return lens.units(s, d).groupBy("translation").agg(F.count("*").alias("n"))


@query("a03_group_max", "select book_order, book, max(chapter) as chapters from units group by all", "units")
def _(s, d):
    return lens.units(s, d).groupBy("book_order", "book").agg(F.max("chapter").alias("chapters")).orderBy("book_order")


@query("a04_bounds", """with t as (select book, chapter, max(verse_no) as v from lessons group by all)
select book, count(*) as chapters, string_agg(cast(chapter as varchar) || ':' || cast(v as varchar), ',' order by chapter) as max_verse from t group by book""", "units lessons")
def _(s, d):
    """Last verses by chapter, then a map for each book, which has few chapters at any size of the table."""
    from ..functions.refs import bounds_of

    entries = F.map_entries(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "last")))))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return bounds_of(lens.lessons(s, d)).groupBy("book").agg(F.count("*").alias("chapters"), text.alias("max_verse"))


@query("a05_nullable_count", "select c.c_nationkey, count(o.o_orderkey) as n from customer c left join orders o on o.o_custkey = c.c_custkey group by all")
def _(s, d):
    per = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(s, d, "customer")
    return c.join(per, c["c_custkey"] == per["o_custkey"], "left").groupBy("c_nationkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("a06_distinct", "select book, count(distinct chapter) as n from units group by book", "units")
def _(s, d):
    return N.count(N.build(lens.units(s, d), ["book"], "chapter"), ["book"])


@query("a07_distinct_key", "select count(distinct (book, chapter, verse_no)) as n from units", "units")
def _(s, d):
    return lens.units(s, d).agg(F.countDistinct(F.struct("book", "chapter", "verse_no")).alias("n"))


_DUPS = "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1"


@query("a08_dups", _DUPS)
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("a09_dup_groups", f"select count(*) as n from ({_DUPS})")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))


@query("a10_excess", f"select cast(coalesce(sum(n - 1), 0) as bigint) as excess from ({_DUPS})")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


@query("a11_reasons", "select count(*) filter (where ev = 0) as open_end, count(*) filter (where sv = 0) as open_start, count(*) filter (where sc <> ec) as crossing from notes", "notes")
def _(s, d):
    return lens.notes(s, d).agg(F.count_if(F.col("ev") == 0).alias("open_end"), F.count_if(F.col("sv") == 0).alias("open_start"), F.count_if(F.col("sc") != F.col("ec")).alias("crossing"))


@query("a12_multimap", "select number, string_agg(cast(id as varchar) || '=' || source_id, ';' order by id) as entries from lex group by number", "lex")
def _(s, d):
    lists = F.array_sort(F.collect_list(F.struct("id", "source_id")))
    return lens.lex(s, d).groupBy("number").agg(F.array_join(F.transform(lists, lambda x: F.concat_ws("=", x["id"].cast("string"), x["source_id"])), ";").alias("entries"))


@query("a13_ordered_concat", "select conv_id, string_agg(role, ',' order by turn, role) as roles from conversations group by conv_id")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.expr("listagg(role, ',') within group (order by turn, role)").alias("roles"))


@query("a14_keep_longest", "select source, arg_max(doc_id, (length(text), -doc_id)) as doc_id from documents group by source")
def _(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))


@query("a15_scored_best", "select source, arg_max(doc_id, (100000 * (case when starts_with(lower(text), 'the') then 1 else 0 end) + length(text), -doc_id)) as doc_id from documents group by source")
def _(s, d):
    score = 100000 * F.lower("text").startswith("the").cast("int") + F.length("text")
    return table(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(score, -F.col("doc_id"))).alias("doc_id"))


@query("a16_first_row", "select number, arg_min(definition, id) as definition from lex group by number", "lex")
def _(s, d):
    return lens.lex(s, d).groupBy("number").agg(F.min_by("definition", "id").alias("definition"))


@query("a17_argmax", "select office, arg_max(seq, (length(text), -seq)) as seq from liturgy group by office", "liturgy")
def _(s, d):
    return lens.liturgy(s, d).groupBy("office").agg(F.max_by("seq", F.struct(F.length("text"), -F.col("seq"))).alias("seq"))


@query("a18_first_sight", "select source_id, min(id) as first_id from notes group by source_id", "notes")
def _(s, d):
    return lens.notes(s, d).groupBy("source_id").agg(F.min("id").alias("first_id")).orderBy("first_id")


@query("a19_percent", "select plan_id, round(100.0::double * count(distinct day) / 400, 1) as percent from checkins group by plan_id", "checkins")
def _(s, d):
    return lens.checkins(s, d).groupBy("plan_id").agg(F.round(F.lit(100.0) * F.countDistinct("day") / 400, 1).alias("percent"))


@query("a20_span_coverage", "with c as (select unnest(range(1, 367)) as day) select cast(c.day as bigint) as day from c anti join checkins k on k.day = c.day and k.plan_id = 1", "checkins")
def _(s, d):
    own = lens.checkins(s, d).where("plan_id = 1").select("plan_id", "day")
    # the plan is there also before its first check-in
    plan = s.range(1).select(F.lit(1).cast("long").alias("plan_id"), F.lit(None).cast("long").alias("day"))
    return N.missing(N.build(own.unionByName(plan), ["plan_id"], "day"), ["plan_id"], 1, 366, "day").select("day")


@query("a21_tag_share", """select page_id, round(case when length(html) = 0 then 0 else coalesce(list_sum(list_transform(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: length(x))), 0) / length(html)::double end, 6) as share from pages""")
def _(s, d):
    inner = F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1))
    total = F.aggregate(F.transform(inner, lambda x: F.length(x)), F.lit(0), lambda a, x: a + x)
    return table(s, d, "pages").select("page_id", F.round(F.when(F.length("html") == 0, F.lit(0.0)).otherwise(total / F.length("html")), 6).alias("share"))


# ---- order, limits, sampling, sets


@query("o01_order", "select book_order, chapter, verse_no from units where translation = 'de'", "units")
def _(s, d):
    return lens.units(s, d).where("translation = 'de'").select("book_order", "chapter", "verse_no").orderBy("book_order", "chapter", "verse_no")


@query("o02_limit", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 20")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("o03_offset", "select chapter, verse_no, text from units where translation = 'en' order by book_order, chapter, verse_no limit 1 offset 25", "units")
def _(s, d):
    return lens.units(s, d).where("translation = 'en'").orderBy("book_order", "chapter", "verse_no").offset(25).limit(1).select("chapter", "verse_no", "text")


@query("o04_tuple_key", "select dev_id, row_number() over (partition by ch order by ve - vs, coalesce(list_position(['purchase', 'view', 'click'], source_id), 99), dev_id) as place from anchors", "anchors")
def _(s, d):
    rank = F.array_position(F.lit(["purchase", "view", "click"]), F.col("source_id"))
    w = Window.partitionBy("ch").orderBy(F.col("ve") - F.col("vs"), F.when(rank > 0, rank).otherwise(99), "dev_id")
    return lens.anchors(s, d).select("dev_id", big(F.row_number().over(w)).alias("place"))


@query("o05_priority_order", "select id, coalesce(list_position(['Brand#31', 'Brand#11'], source_id), 3) as rank from notes", "notes")
def _(s, d):
    rank = F.array_position(F.lit(["Brand#31", "Brand#11"]), F.col("source_id"))
    return lens.notes(s, d).select("id", F.when(rank > 0, rank).otherwise(3).cast("int").alias("rank"))


@query("o06_brief", "select conv_id, array_to_string(list_slice(list(role order by turn, role), 1, 3), ',') as roles, count(*) as total from conversations group by conv_id")
def _(s, d):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.slice(roles, 1, 3), ",").alias("roles"), F.count("*").alias("total"))


@query("o07_hash_pick", """with c as (select count(*) as n from units where translation = 'en'), days as (select unnest(['2026-09-20', '2024-02-29', '2025-01-01']) as day),
h as (select day, n, sha256(day || '|en') as x from days, c),
k as (select day, list_reduce(list_prepend(0::bigint, list_transform(range(1, 65), lambda i: cast(instr('0123456789abcdef', substr(x, cast(i as int), 1)) - 1 as bigint))), lambda a, b: (a * 16 + b) % n) as pos from h),
r as (select chapter, verse_no, text, row_number() over (order by book_order, chapter, verse_no) - 1 as pos from units where translation = 'en')
select day, chapter, verse_no, text from k join r using (pos)""", "units")
def _(s, d):
    from .composites import verse_of_day

    return verse_of_day(lens.units(s, d), "en", ["2026-09-20", "2024-02-29", "2025-01-01"]).select("day", "chapter", "verse_no", "text")


@query("o08_sample", "select doc_id from (select doc_id, sha256(cast(doc_id as varchar) || '|20260920') as k from documents) order by k limit 24")
def _(s, d):
    return table(s, d, "documents").select("doc_id").orderBy(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("20260920")), 256)).limit(24)


@query("o09_stratified", "select doc_id, lang from documents qualify row_number() over (partition by lang order by sha256(cast(doc_id as varchar) || '|7')) <= (case lang when 'en' then 30 else 10 end)")
def _(s, d):
    key = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("7")), 256)
    ranked = table(s, d, "documents").select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(key)).alias("n"))
    return ranked.where(F.col("n") <= F.when(F.col("lang") == "en", 30).otherwise(10)).select("doc_id", "lang")


@query("t01_union", "select id, text, 'note' as kind from notes union all select id, definition, 'lexicon' from lex", "notes lex")
def _(s, d):
    return lens.notes(s, d).select("id", "text", F.lit("note").alias("kind")).unionByName(lens.lex(s, d).select("id", F.col("definition").alias("text"), F.lit("lexicon").alias("kind")))


@query("t02_except", "select l_suppkey % 50 as k from lineitem except select s_suppkey % 37 from supplier")
def _(s, d):
    a = table(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("k"))
    return a.distinct().exceptAll(table(s, d, "supplier").select((F.col("s_suppkey") % 37).alias("k")).distinct())


@query("t03_intersect", "select n_name as name from nation intersect select upper(r_name) from region union all select p_brand from part where p_partkey <= 3")
def _(s, d):
    shared = table(s, d, "nation").select(F.col("n_name").alias("name")).intersect(table(s, d, "region").select(F.upper("r_name").alias("name")))
    return shared.unionAll(table(s, d, "part").where("p_partkey <= 3").select(F.col("p_brand").alias("name")))


@query("t04_subset", "select not exists (select o_custkey from orders except select c_custkey from customer) as orders_known, not exists (select c_custkey from customer except select o_custkey from orders) as all_order")
def _(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    none = lambda df, name: df.agg((F.count("*") == 0).alias(name))
    return none(J.orphans(o, "o_custkey", c, "c_custkey"), "orders_known").join(none(J.orphans(c, "c_custkey", o, "o_custkey"), "all_order"))


@query("t05_distinct", "select distinct p_brand, p_type from part")
def _(s, d):
    return table(s, d, "part").select("p_brand", "p_type").distinct()


@query("t06_set_sorted", "select distinct head, line, ref from edges", "edges")
def _(s, d):
    return lens.edges(s, d).distinct().orderBy("head", "line", "ref")


_PARTS = "a as (select head, line, ref from edges where ref % 2 = 0), b as (select head, line, min(ref) as ref from edges where ref % 2 = 1 group by all)"


@query("t07_insert_ignore", f"with {_PARTS} select * from a union all select b.* from b anti join a using (head, line)", "edges")
def _(s, d):
    from ..operators.lifecycle import insert_or_ignore

    e = lens.edges(s, d)
    return insert_or_ignore(e.where("ref % 2 = 0"), e.where("ref % 2 = 1"), ["head", "line"], ["ref"])


@query("t08_upsert", "select plan_id, start_date, day, event_id from checkins qualify row_number() over (partition by plan_id, start_date, day order by checked_at desc, event_id desc) = 1", "checkins")
def _(s, d):
    from ..operators.lifecycle import last_wins

    return last_wins(lens.checkins(s, d), ["plan_id", "start_date", "day"], ["checked_at", "event_id"]).select("plan_id", "start_date", "day", "event_id")


@query("t09_first_wins", "select head, line, ref, row_number() over (partition by head, line order by ref) = 1 as accepted from (select distinct head, line, ref from edges)", "edges")
def _(s, d):
    w = Window.partitionBy("head", "line").orderBy("ref")
    return lens.edges(s, d).distinct().withColumn("accepted", F.row_number().over(w) == 1)
