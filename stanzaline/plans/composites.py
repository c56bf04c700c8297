"""Composite queries: what a reader asks for, out of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import scalars as D
from ..functions import text as T
from ..operators import joins as J
from ..operators import search_index as X
from ..operators import windows as W
from . import lens
from .lens import query, table
from .texts import _ON, _THE, BM25_SQL


def verse_of_day(units: DataFrame, translation: str, days: list[str]) -> DataFrame:
    """For each date the verse at a hash of date and code, counted in canonical order.

    Verses are counted per chapter first; a verse's place is its chapter's offset and its number within
    the chapter, so no task sorts the whole text.
    """
    own = units.where(F.col("translation") == translation)
    per = own.groupBy("book_order", "chapter").agg(F.count("*").alias("n"))
    # offsets of chapters: books first, then chapters in a book
    in_book = Window.partitionBy("book_order").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    before = canonical_places(per.groupBy("book_order").agg(F.sum("n").alias("size")))
    offsets = per.withColumn("in_book", F.coalesce(F.sum("n").over(in_book), F.lit(0))).join(before, "book_order")
    offsets = offsets.select("book_order", "chapter", (F.col("book_at") + F.col("in_book")).alias("low"), "n")
    spark = units.sparkSession
    total = per.agg(F.sum("n").alias("total"))
    asked = spark.createDataFrame([(x,) for x in days], "day string").join(F.broadcast(total))
    asked = asked.withColumn("at", D.hash_modulo(F.concat_ws("|", "day", F.lit(translation)), F.col("total")))
    where = J.meet_intervals(asked, offsets, [], "at", F.col("low"), F.col("low") + F.col("n") - 1)
    number = Window.partitionBy("day", "book_order", "chapter").orderBy("verse_no")
    rows = own.join(where.select("day", "book_order", "chapter", (F.col("at") - F.col("low") + 1).alias("k")), ["book_order", "chapter"])
    return rows.withColumn("n", F.row_number().over(number)).where("n = k").select("day", "translation", "book", "chapter", "verse_no", "text")


# ---- queries


big = lambda x: x.cast("long")

_PASSAGES = ["src3 3:1-2", "src7 7", "src5 5:1,3", "src0 20:2", "nowhere 1", "src3 9999"]


def passages(spark: SparkSession, units: DataFrame, refs: list[str]) -> DataFrame:
    """Verses of literal references, in the order of reference, span and verse; unreadable ones give none.

    Only the chapters that they name are read, for their bounds and for their text.
    """
    own = R.within_chapters(units, refs)
    names = own.select(F.lower("book").alias("alias"), "book").where("book is not null").distinct()
    asked = spark.createDataFrame(list(enumerate(refs)), "ref_ix int, ref string")
    parsed = R.parse_references(asked, "ref", names, R.bounds_of(own))
    return J.resolve_passages(parsed, own)


@query("j07_passage", """with r as (select * from (values (0, 0, 'src3', 3, 1, 2), (1, 0, 'src7', 7, 1, 999999), (2, 0, 'src5', 5, 1, 1), (2, 1, 'src5', 5, 3, 3), (3, 0, 'src0', 20, 2, 2)) t(ref_ix, span_ix, book, chapter, vs, ve)),
b as (select book, chapter, max(verse_no) as top from units group by all),
ok as (select r.ref_ix from r left join b on b.book = r.book and b.chapter = r.chapter group by r.ref_ix having bool_and(b.top is not null and (r.ve = 999999 or r.ve <= b.top)))
select r.ref_ix, r.span_ix, u.book, u.chapter, u.verse_no, u.text from r join ok using (ref_ix) join units u on u.book = r.book and u.chapter = r.chapter and u.verse_no between r.vs and r.ve""", "units")
def _(s, d):
    return passages(s, lens.units(s, d), _PASSAGES).select("ref_ix", "span_ix", "book", "chapter", "verse_no", "text")


@query("c01_health", "select 'ok' as status, count(*) as verses from units", "units")
def _(s, d):
    return lens.units(s, d).agg(F.lit("ok").alias("status"), F.count("*").alias("verses"))


@query("c02_translations", "with r as (select * from (values ('en', 'English'), ('de', 'Deutsch'), ('xx', 'None')) t(code, name)) select r.code, r.name, count(u.translation) as verses from r left join units u on u.translation = r.code group by all", "units")
def _(s, d):
    registry = s.createDataFrame([("en", "English"), ("de", "Deutsch"), ("xx", "None")], "code string, name string")
    return J.with_counts(registry, lens.units(s, d).withColumnRenamed("translation", "code"), "code", "book").select("code", "name", F.col("n").alias("verses"))


@query("c03_books", "select book_order, book, count(distinct chapter) as chapters from units where translation = 'en' group by all", "units")
def _(s, d):
    return lens.units(s, d).where("translation = 'en'").groupBy("book_order", "book").agg(F.countDistinct("chapter").alias("chapters"))


@query("c04_passage", "select book || ' ' || chapter || ':' || verse_no as ref, text from units where book = 'src3' and chapter = 3 and verse_no between 1 and 1", "units")
def _(s, d):
    found = passages(s, lens.units(s, d), ["Src3 3:1"])
    return found.select(F.format_string("%s %d:%d", "book", "chapter", "verse_no").alias("ref"), "text")


@query("c05_compare", "select chapter, verse_no, coalesce(min(text) filter (where translation = 'en'), '') as en, coalesce(min(text) filter (where translation = 'es'), '') as es from units where book = 'src3' and translation in ('en', 'es') group by all", "units")
def _(s, d):
    side = J.side_by_side(lens.units(s, d).where("book = 'src3'"), ["en", "es"], ["chapter", "verse_no"])
    return side.select("chapter", "verse_no", F.coalesce("en", F.lit("")).alias("en"), F.coalesce("es", F.lit("")).alias("es"))


@query("c06_search", "with " + BM25_SQL.format(a=_THE, b=_ON) + " select sc.doc_id, round(score, 6) as score from sc join documents d on d.doc_id = sc.doc_id where d.lang = 'en' order by round(sc.score, 10) desc, sc.doc_id limit 20", "tokens")
def _(s, d):
    """Statistics of the whole corpus, then the translation filter, then the best twenty."""
    docs = table(s, d, "documents").select("doc_id", "lang", "text")
    return X.search(lens.index(s, d), docs, "the ones", F.col("lang") == "en").select("doc_id", F.round("score", 6).alias("score"))


@query("c07_verse_of_day", """with c as (select count(*) as n from units where translation = 'de'), h as (select n, sha256('2026-09-20|de') as x from c),
k as (select list_reduce(list_prepend(0::bigint, list_transform(range(1, 65), lambda i: cast(instr('0123456789abcdef', substr(x, cast(i as int), 1)) - 1 as bigint))), lambda a, b: (a * 16 + b) % n) as pos from h),
r as (select book, chapter, verse_no, row_number() over (order by book_order, chapter, verse_no) - 1 as pos from units where translation = 'de') select book, chapter, verse_no from k join r using (pos)""", "units")
def _(s, d):
    return verse_of_day(lens.units(s, d), "de", ["2026-09-20"]).select("book", "chapter", "verse_no")


# topics and moods: words of p_type stand for moods, parts for topics


@query("c08_topics", "select p_partkey as id, p_name as label from part")
def _(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))


@query("c09_topic", "select k.l_orderkey as ref, p.p_name as label from part p join (select distinct l_partkey, l_orderkey from lineitem) k on k.l_partkey = p.p_partkey where p.p_partkey = 7")
def _(s, d):
    refs = table(s, d, "lineitem").where("l_partkey = 7").select("l_partkey", F.col("l_orderkey").alias("ref")).distinct()
    return table(s, d, "part").where("p_partkey = 7").join(refs, F.col("p_partkey") == F.col("l_partkey")).select("ref", F.col("p_name").alias("label"))


@query("c10_moods", "select mood, count(*) as topics from (select p_partkey, unnest(list_distinct(string_split(p_type, ' '))) as mood from part) group by mood")
def _(s, d):
    moods = table(s, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_type", " "))).alias("mood"))
    return moods.groupBy("mood").agg(F.count("*").alias("topics"))


@query("c11_mood", "select p_partkey as topic, count(distinct l_orderkey) as refs from part left join lineitem on l_partkey = p_partkey where list_contains(string_split(p_type, ' '), split_part((select min(p_type) from part), ' ', 1)) group by p_partkey")
def _(s, d):
    p = table(s, d, "part")
    mood = p.agg(F.substring_index(F.min("p_type"), " ", 1).alias("mood"))
    topics = p.join(F.broadcast(mood)).where(F.array_contains(F.split("p_type", " "), F.col("mood"))).select(F.col("p_partkey").alias("topic"))
    refs = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("topic")).agg(F.countDistinct("l_orderkey").alias("refs"))
    return topics.join(refs, "topic", "left").select("topic", F.coalesce("refs", F.lit(0)).alias("refs"))


def canonical_places(sizes: DataFrame) -> DataFrame:
    """For each book (book_order, size) how many rows the books before it have, and how many there are in all.

    Books are a canon's: their list fits in one row, which every book is then compared with.
    """
    every = sizes.agg(F.collect_list(F.struct("book_order", "size")).alias("every"))
    met = sizes.crossJoin(F.broadcast(every))
    total = lambda keep: F.aggregate(F.filter("every", keep), F.lit(0).cast("long"), lambda n, b: n + b["size"])
    return met.select("book_order", total(lambda b: b["book_order"] < F.col("book_order")).alias("book_at"), total(lambda b: F.lit(True)).alias("total"))


def reading_plan(chapters: DataFrame, days: int) -> DataFrame:
    """(day, refs): chapters (book_order, book, chapter) split evenly over the days, runs of a book as ranges.

    A chapter's place is its book's offset and its place in the book, so no task orders the whole canon;
    its day follows from the place, the first days taking one chapter more where it does not come out even.
    """
    nth = F.row_number().over(Window.partitionBy("book_order", "book").orderBy("chapter"))
    numbered = chapters.withColumn("nth", nth)
    places = canonical_places(chapters.groupBy("book_order").agg(F.count("*").alias("size")))
    placed = numbered.join(places, "book_order").withColumn("rank", F.col("book_at") + F.col("nth") - 1)
    base, more = F.floor(F.col("total") / days), F.col("total") % days
    large = more * (base + 1)
    day = F.when(F.col("rank") < large, F.floor(F.col("rank") / (base + 1))).otherwise(more + F.floor((F.col("rank") - large) / F.greatest(base, F.lit(1)))) + 1
    # within a day a book's chapters are one run, since places are consecutive
    runs = placed.withColumn("day", day).groupBy("day", "book_order", "book").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"))
    ref = F.when(F.col("first") == F.col("last"), F.format_string("%s %d", "book", "first")).otherwise(F.format_string("%s %d-%d", "book", "first", "last"))
    refs = F.array_sort(F.collect_list(F.struct("book_order", ref.alias("ref"))))
    return runs.groupBy("day").agg(F.array_join(F.transform(refs, lambda x: x["ref"]), "; ").alias("refs"))


_PLAN = """with c as (select distinct book_order, book, chapter from units), n as (select *, ntile({days}) over (order by book_order, chapter) as day, row_number() over (partition by book order by chapter) as nth from c),
i as (select *, nth - row_number() over (partition by day, book order by nth) as run from n), r as (select day, book_order, book, min(nth) as low, min(chapter) as first, max(chapter) as last from i group by day, book_order, book, run),
p as (select day, string_agg(book || ' ' || first || (case when first = last then '' else '-' || last end), '; ' order by book_order, low) as refs from r group by day)"""


@query("c12_plans", _PLAN.format(days=90) + " select 'ninety' as plan, count(*) as days from p", "units")
def _(s, d):
    chapters = lens.units(s, d).select("book_order", "book", "chapter").distinct()
    return reading_plan(chapters, 90).agg(F.lit("ninety").alias("plan"), F.count("*").alias("days"))


@query("c13_plan", _PLAN.format(days=30) + " select cast(day as bigint) as day, refs from p", "units")
def _(s, d):
    chapters = lens.units(s, d).select("book_order", "book", "chapter").distinct()
    return reading_plan(chapters, 30).select(big(F.col("day")).alias("day"), "refs")


@query("c14_plan_today", _PLAN.format(days=30) + " select cast(day as bigint) as day, 'active' as status, refs from p where day = date_diff('day', date '2026-09-01', date '2026-09-20') + 1", "units")
def _(s, d):
    chapters = lens.units(s, d).select("book_order", "book", "chapter").distinct()
    day, status = D.plan_day(F.lit("2026-09-01").cast("date"), F.lit("2026-09-20").cast("date"), 30)
    return reading_plan(chapters, 30).where(F.col("day") == day).select(big(F.col("day")).alias("day"), status.alias("status"), "refs")


@query("c15_checkin", "select plan_id, day, event_id from checkins where day between 1 and 365 qualify row_number() over (partition by plan_id, day order by checked_at desc, event_id desc) = 1", "checkins")
def _(s, d):
    from ..operators.lifecycle import last_wins

    return last_wins(lens.checkins(s, d).where(F.col("day").between(1, 365)), ["plan_id", "day"], ["checked_at", "event_id"]).select("plan_id", "day", "event_id")


@query("c16_progress", "select plan_id, count(distinct day) as done, round(100.0::double * count(distinct day) / 365, 1) as percent from checkins where day between 1 and 365 group by plan_id", "checkins")
def _(s, d):
    own = lens.checkins(s, d).where(F.col("day").between(1, 365)).groupBy("plan_id").agg(F.countDistinct("day").alias("done"))
    return own.select("plan_id", "done", F.round(F.lit(100.0) * F.col("done") / 365, 1).alias("percent"))


@query("c16_progress_stream", "select plan_id, count(distinct day) as done, round(100.0::double * count(distinct day) / 365, 1) as percent from checkins where day between 1 and 365 group by plan_id", "checkins")
def _(s, d):
    """The same from a stream of the events, by keyed state."""
    from ..sources.places import fresh_folder
    from ..streaming import progress as P

    # a pattern, since a plain path of a stream must be a folder
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/[e]vents.parquet")
    own, path = lens.checkins_of(events).select("plan_id", "day", F.col("checked_at").alias("at"), F.col("event_id").alias("n")), fresh_folder(s, "progress")
    P.track(own, P.keep(f"{path}/rows"), f"{path}/mark").awaitTermination()
    return P.current(s.read.parquet(f"{path}/rows")).select("plan_id", "done", "percent")


@query("c17_study", f"""with n as (select k.book_order, k.ch, k.v, n.id from keys k join notes n on n.book_order = k.book_order and ((n.sc < k.ch) or (n.sc = k.ch and (n.sv = 0 or n.sv <= k.v))) and ((n.ec > k.ch) or (n.ec = k.ch and (n.ev = 0 or n.ev >= k.v)))),
g as (select book_order, ch, v, count(*) as notes, string_agg(cast(id as varchar), ',' order by id) filter (where rn <= 25) as shown from (select *, row_number() over (partition by book_order, ch, v order by id) as rn from n) group by all)
select k.book_order, k.ch, k.v, coalesce(g.notes, 0) as notes, coalesce(g.shown, '') as shown from keys k left join g using (book_order, ch, v)""", "keys notes")
def _(s, d):
    """Each key's covering notes, the first 25 and their number."""
    keys = lens.keys(s, d)
    met = J.covering_notes(keys, lens.notes(s, d)).select("book_order", "ch", "v", "id")
    ranked = W.renumber(met, ["book_order", "ch", "v"], ["id"])
    shown = F.array_sort(F.collect_list(F.when(F.col("n") <= 25, F.col("id"))))
    per = ranked.groupBy("book_order", "ch", "v").agg(F.count("*").alias("notes"), F.array_join(F.transform(shown, lambda x: x.cast("string")), ",").alias("shown"))
    return keys.join(per, ["book_order", "ch", "v"], "left").select("book_order", "ch", "v", F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("shown", F.lit("")).alias("shown"))


@query("c18_commentary", "select n.id, n.text from notes n where n.book_order = 5 and ((n.sc < 2) or (n.sc = 2 and (n.sv = 0 or n.sv <= 1))) and ((n.ec > 2) or (n.ec = 2 and (n.ev = 0 or n.ev >= 1)))", "notes")
def _(s, d):
    return lens.notes(s, d).where("book_order = 5").where(J.covers(F.lit(2), F.lit(1))).select("id", "text")


@query("c19_cross_refs", "with l as (select max(o_orderkey) as head from orders group by o_custkey) select distinct e.head, e.line, e.ref from edges e join l on l.head = e.head", "edges")
def _(s, d):
    """All links of each customer's last order."""
    heads = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("head")).select("head")
    return lens.edges(s, d).join(heads, "head", "left_semi").distinct()


@query("c20_devotional", """with e as (select event_id, dayofyear(ts) as n, hour(ts) < 12 as morning from events)
select n as day, coalesce(min(event_id) filter (where morning), -1) as morning, coalesce(min(event_id) filter (where not morning), -1) as evening from e group by n""")
def _(s, d):
    e = table(s, d, "events").select("event_id", big(D.leap_day_of_year(F.col("ts").cast("date"))).alias("day"), F.when(F.hour("ts") < 12, "morning").otherwise("evening").alias("part"))
    side = e.groupBy("day").pivot("part", ["morning", "evening"]).agg(F.min("event_id"))
    return side.select("day", F.coalesce("morning", F.lit(-1)).alias("morning"), F.coalesce("evening", F.lit(-1)).alias("evening"))


@query("c21_prayer", "select office, seq, speaker, text from liturgy where office = 3 order by seq", "liturgy")
def _(s, d):
    return lens.liturgy(s, d).where("office = 3").orderBy("seq")


@query("c22_memory_pack", "select row_number() over (order by verse_no) as item, text from units where book = 'src7' and chapter = 7 order by item limit 10", "units")
def _(s, d):
    """Ten verses at most, numbered after the limit."""
    ten = passages(s, lens.units(s, d), ["src7 7"]).orderBy("ref_ix", "span_ix", "verse_no").limit(10)
    number = F.row_number().over(Window.partitionBy("book").orderBy("ref_ix", "span_ix", "verse_no"))
    return ten.select(big(number).alias("item"), "text")


@query("c23_word_sources", "select s.source_id, s.rights, count(x.id) as entries from lex_src s left join lex x using (source_id) group by all", "lex lex_src")
def _(s, d):
    return J.with_counts(lens.lex_src(s, d), lens.lex(s, d), "source_id", "id").select("source_id", "rights", F.col("n").alias("entries"))


@query("c24_interlinear", "with t as (select doc_id, max(case when is_variant = 0 then 1 else 0 end) as main from words group by doc_id) select w.doc_id, case when t.main = 1 then 'main' else 'variant' end as reading, count(*) as n from words w join t using (doc_id) where w.is_variant = 1 - t.main group by all", "words")
def _(s, d):
    """Main words where a verse has any, else its variants."""
    w = lens.words(s, d).groupBy("doc_id").agg(F.count_if(F.col("is_variant") == 0).alias("main"), F.count_if(F.col("is_variant") == 1).alias("variant"))
    return w.select("doc_id", F.when(F.col("main") > 0, "main").otherwise("variant").alias("reading"), F.when(F.col("main") > 0, F.col("main")).otherwise(F.col("variant")).alias("n"))


@query("c25_verse_study", """with r as (select head, ref, row_number() over (partition by head order by ref) as rn from (select distinct head, ref from edges)),
x as (select head, count(*) as refs, string_agg(cast(ref as varchar), ',' order by ref) filter (where rn <= 8) as top from r group by head),
k as (select o_orderkey as head, 'H' || cast(o_custkey % 500 as varchar) as base, cast(o_orderkey % 20 as int) as book_order from orders),
def as (select 'H' || cast(id % 500 as varchar) as base, source_id, definition, row_number() over (partition by id % 500 order by list_position(['Brand#13', 'Brand#22', 'Brand#31', 'Brand#44', 'Brand#55'], source_id), id) as rn from lex where list_position(['Brand#13', 'Brand#22', 'Brand#31', 'Brand#44', 'Brand#55'], source_id) > 0),
nn as (select book_order, count(*) as notes from notes where ((sc < 2) or (sc = 2 and (sv = 0 or sv <= 3))) and ((ec > 2) or (ec = 2 and (ev = 0 or ev >= 3))) group by book_order)
select k.head, k.base, coalesce(d.source_id, '') as source_id, coalesce(d.definition, '') as definition, coalesce(x.refs, 0) as refs, coalesce(x.top, '') as top, coalesce(nn.notes, 0) as notes
from k left join def d on d.base = k.base and d.rn = 1 left join x on x.head = k.head left join nn on nn.book_order = k.book_order""", "edges lex notes")
def _(s, d):
    """For each head: its word's definition by source priority, its first eight links and their number, the notes on its verse."""
    order = ["Brand#13", "Brand#22", "Brand#31", "Brand#44", "Brand#55"]
    heads = table(s, d, "orders").select(F.col("o_orderkey").alias("head"), F.concat(F.lit("H"), (F.col("o_custkey") % 500).cast("string")).alias("base"), (F.col("o_orderkey") % 20).cast("int").alias("book_order"))
    lexicon = lens.lex(s, d).withColumn("base", T.drop_zero_pad("number"))
    best = J.first_by_priority(lexicon, "base", "source_id", order, "definition", "id")
    links = W.renumber(lens.edges(s, d).select("head", "ref").distinct(), ["head"], ["ref"])
    top = F.array_sort(F.collect_list(F.when(F.col("n") <= 8, F.col("ref"))))
    links = links.groupBy("head").agg(F.count("*").alias("refs"), F.array_join(F.transform(top, lambda x: x.cast("string")), ",").alias("top"))
    notes = lens.notes(s, d).where(J.covers(F.lit(2), F.lit(3))).groupBy("book_order").agg(F.count("*").alias("notes"))
    out = heads.join(best, "base", "left").join(links, "head", "left").join(notes, "book_order", "left")
    text, number = (lambda c: F.coalesce(c, F.lit("")).alias(c)), (lambda c: F.coalesce(c, F.lit(0)).alias(c))
    return out.select("head", "base", text("source_id"), text("definition"), number("refs"), text("top"), number("notes"))


@query("c26_word", "select x.id, s.rights, x.definition from lex x join lex_src s using (source_id) where x.number = 'H0007'", "lex lex_src")
def _(s, d):
    wanted = F.col("base") == R.lexicon_number(F.lit(" h0007 "))
    return lens.lex(s, d).withColumn("base", T.drop_zero_pad("number")).where(wanted).join(lens.lex_src(s, d), "source_id").select("id", "rights", "definition")


@query("c27_dictionary_sources", "select p_mfgr as source_id, count(*) as entries from (select substr(p_brand, 1, 7) as p_mfgr from part) group by p_mfgr")
def _(s, d):
    return table(s, d, "part").groupBy(F.substring("p_brand", 1, 7).alias("source_id")).agg(F.count("*").alias("entries"))


@query("c28_dictionary", "select p_partkey as id, p_name as text from part where lower(p_type) = (select lower(min(p_type)) from part)")
def _(s, d):
    p = table(s, d, "part")
    term = p.agg(F.lower(F.min("p_type")).alias("term"))
    return p.join(F.broadcast(term), F.lower("p_type") == F.col("term")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


@query("c29_generate_plans", _PLAN.format(days=365) + " select cast(day as bigint) as day, refs from p", "units")
def _(s, d):
    chapters = lens.units(s, d).select("book_order", "book", "chapter").distinct()
    return reading_plan(chapters, 365).select(big(F.col("day")).alias("day"), "refs")
