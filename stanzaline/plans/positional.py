"""Window-like operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans as S
from ..operators import windows as W
from . import lens
from .lens import query, table

big = lambda x: x.cast("long")


@query("w01_renumber", "select doc_id, position, row_number() over (partition by doc_id, word order by position) as n from words", "words")
def _(s, d):
    return W.renumber(lens.words(s, d), ["doc_id", "word"], ["position"]).select("doc_id", "position", big(F.col("n")).alias("n"))


@query("w02_renumber_by_type", "select doc_id, position, row_number() over (partition by doc_id, is_variant order by position) as n from words", "words")
def _(s, d):
    return W.renumber(lens.words(s, d), ["doc_id", "is_variant"], ["position"]).select("doc_id", "position", big(F.col("n")).alias("n"))


@query("w03_lead_end", "with m as (select distinct book_order, sc from notes) select book_order, sc, coalesce(lead(sc) over (partition by book_order order by sc) - 1, 9) as end_at from m", "notes")
def _(s, d):
    starts = lens.notes(s, d).select("book_order", "sc").distinct().withColumn("top", F.lit(9))
    return W.end_before_next(starts, ["book_order"], "sc", "top").select("book_order", "sc", "end_at")


@query("w04_carry_forward", "select conv_id, turn, coalesce(last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role rows unbounded preceding), -1) as asked from conversations")
def _(s, d):
    asked = W.carry_forward(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], ["turn", "role"])
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(asked, F.lit(-1)).alias("asked"))


@query("w05_segments", """with m as (select *, sum(case when verse_no % 5 = 1 then 1 else 0 end) over (partition by chapter order by verse_no rows unbounded preceding) as segment from units)
select chapter, cast(segment as bigint) as segment, string_agg(text, ' ' order by verse_no) as body from m group by all""", "units")
def _(s, d):
    out = W.segments(lens.units(s, d), ["chapter"], "verse_no", F.col("verse_no") % 5 == 1, "text")
    return out.select("chapter", big(F.col("segment")).alias("segment"), "body")


@query("w06_islands", """with m as (select distinct l_suppkey, l_partkey from lineitem), r as (select *, l_partkey - row_number() over (partition by l_suppkey order by l_partkey) as run from m)
select l_suppkey, min(l_partkey) as low, max(l_partkey) as high, count(*) as n from r group by l_suppkey, run""")
def _(s, d):
    return W.islands(table(s, d, "lineitem"), ["l_suppkey"], "l_partkey")


@query("w07_merge_intervals", """with o as (select *, max(ve) over (partition by ch order by vs, ve, dev_id rows between unbounded preceding and 1 preceding) as before from anchors),
i as (select *, sum(case when before is null or vs > before + 1 then 1 else 0 end) over (partition by ch order by vs, ve, dev_id rows unbounded preceding) as island from o)
select ch, min(vs) as low, max(ve) as high, count(*) as n from i group by ch, island""", "anchors")
def _(s, d):
    return W.merge_intervals(lens.anchors(s, d), ["ch"], "vs", "ve", "dev_id")


@query("w08_ntile", "select book, chapter, ntile(7) over (partition by book order by chapter) as bucket from (select distinct book, chapter from units)", "units")
def _(s, d):
    chapters = lens.units(s, d).select("book", "chapter").distinct()
    return W.even_split(chapters, ["book"], ["chapter"], 7).withColumn("bucket", big(F.col("bucket")))


@query("w09_look_ahead", """select chapter, verse_no, coalesce(first_value(case when length(text) > 200 then verse_no end ignore nulls) over (partition by chapter order by verse_no rows between 1 following and 45 following), -1) as ahead from units""", "units")
def _(s, d):
    ahead = W.look_ahead(F.when(F.length("text") > 200, F.col("verse_no")), ["chapter"], "verse_no", 45)
    return lens.units(s, d).select("chapter", "verse_no", F.coalesce(ahead, F.lit(-1)).alias("ahead"))


@query("w10_look_behind", """select chapter, verse_no, coalesce(max(case when text like '%license%' then 1 else 0 end) over (partition by chapter order by verse_no rows between 8 preceding and 1 preceding), 0) = 1 as after_license from units""", "units")
def _(s, d):
    before = W.looked_back(F.col("text").like("%license%"), ["chapter"], "verse_no", 8)
    return lens.units(s, d).select("chapter", "verse_no", F.exists(before, lambda x: x).alias("after_license"))


@query("w11_lag_not_blank", """with l as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as line_no from (select doc_id, string_split(text, chr(10)) as l from documents))
select doc_id, line_no, coalesce(last_value(nullif(trim(line), '') ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), '') as before from l""")
def _(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")
    return lines.select("doc_id", "line_no", F.coalesce(W.last_not_blank("line", ["doc_id"], "line_no"), F.lit("")).alias("before"))


@query("w12_topk", "select source, doc_id, n_chars from documents qualify row_number() over (partition by source order by n_chars desc, doc_id) <= 3")
def _(s, d):
    return W.top_k(table(s, d, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id", "n_chars")


@query("w13_running_item", "select row_number() over (order by o_totalprice desc, o_orderkey) as n, o_orderkey from orders where o_orderstatus = 'F' order by n limit 10")
def _(s, d):
    """The ten first by a top-k before they are numbered, so that only ten rows meet in one task."""
    ten = table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    from pyspark.sql import Window

    return ten.select(big(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("o_totalprice"), "o_orderkey"))).alias("n"), "o_orderkey")


@query("w14_first_seen", """select id, ch, v from (select n.id, k.ch, k.v, row_number() over (partition by n.id order by k.ch, k.v) as rn from keys k join notes n on n.book_order = k.book_order
and ((n.sc < k.ch) or (n.sc = k.ch and (n.sv = 0 or n.sv <= k.v))) and ((n.ec > k.ch) or (n.ec = k.ch and (n.ev = 0 or n.ev >= k.v)))) where rn = 1""", "keys notes")
def _(s, d):
    from ..operators.joins import covering_notes

    return W.first_seen(covering_notes(lens.keys(s, d), lens.notes(s, d)), ["id"], ["ch", "v"]).select("id", "ch", "v")


@query("w15_not_increasing", "select conv_id, turn from (select conv_id, turn, length(text) as n, lag(length(text)) over (partition by conv_id order by turn, role) as before from conversations) where n <= before")
def _(s, d):
    c = table(s, d, "conversations").withColumn("size", F.length("text")).withColumn("at", F.struct("turn", "role"))
    return W.not_increasing(c, ["conv_id"], "at", "size").select("conv_id", "turn")


@query("w16_repair_ranges")
def _(s, d):
    ranges = F.transform(F.array_sort(F.collect_set(F.struct(F.col("sv").alias("s"), F.col("ev").alias("e")))), lambda r: r)
    per = lens.notes(s, d).groupBy("book_order", "sc").agg(ranges.alias("r"))
    fixed = W.repair_ranges(F.col("r"), F.lit(40))
    return per.select("book_order", "sc", F.array_join(F.transform(fixed, lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",").alias("ranges"))


@query("w18_sequence", "select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role) as seq from conversations")
def _(s, d):
    return W.renumber(table(s, d, "conversations"), ["conv_id"], ["turn", "role"], "seq").select("conv_id", "turn", "role", big(F.col("seq")).alias("seq"))


@query("w19_runs", """with c as (select conv_id, role, turn, text from conversations), r as (select *, row_number() over (partition by conv_id order by turn) - row_number() over (partition by conv_id, role order by turn) as run from c),
j as (select conv_id, role, run, min(turn) as first, string_agg(text, ' ' order by turn) as body from r group by all)
select conv_id, role, count(*) as runs, arg_max(body, (length(body), -first)) as body from j group by conv_id, role""")
def _(s, d):
    return W.runs_or_longest(table(s, d, "conversations"), ["conv_id"], "role", "turn", "text")


@query("w20_page_join", """with m as (select chapter, verse_no, text, coalesce(not regexp_matches(text, '[.!?]$'), false) and lead(text) over (partition by chapter order by verse_no) is not null as joins from units),
c as (select *, sum(case when coalesce(pj, false) then 0 else 1 end) over (partition by chapter order by verse_no rows unbounded preceding) as chain from (select *, lag(joins) over (partition by chapter order by verse_no) as pj from m))
select chapter, min(verse_no) as verse_no, string_agg(text, ' ' order by verse_no) as text, count(*) as parts from c group by chapter, chain""", "units")
def _(s, d):
    return W.join_with_next(lens.units(s, d), ["chapter"], "verse_no", "text", ~F.col("text").rlike("[.!?]$")).select("chapter", "verse_no", "text", "parts")


@query("q02_running_max", "select conv_id, turn from (select conv_id, turn, length(text) as k, max(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as before from conversations) where before is null or k >= before")
def _(s, d):
    c = table(s, d, "conversations").withColumn("k", F.length("text"))
    return W.running_max_accept(c, ["conv_id"], "turn", "k").select("conv_id", "turn")


@query("w01_one_stream", "select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber) as n from lineitem")
def _(s, d):
    """Places in the whole table as one stream; so are the next five: blocks of its order, no window over all of it."""
    return S.number(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), [], ["l_orderkey", "l_linenumber"]).withColumn("n", big(F.col("n")))


@query("w04_one_stream", "select o_orderkey, last_value(case when o_orderstatus = 'F' then o_custkey end ignore nulls) over (order by o_orderkey rows unbounded preceding) as marker from orders")
def _(s, d):
    marker = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))
    return S.carry_forward(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), [], ["o_orderkey"], marker, "marker").select("o_orderkey", "marker")


@query("w05_one_stream", """with m as (select *, sum(case when o_orderstatus = 'P' then 1 else 0 end) over (order by o_orderkey rows unbounded preceding) as segment from orders)
select cast(segment as bigint) as segment, string_agg(o_orderpriority, ' ' order by o_orderkey) as body from m group by segment""")
def _(s, d):
    return S.segments(table(s, d, "orders"), [], "o_orderkey", F.col("o_orderstatus") == "P", "o_orderpriority").select(big(F.col("segment")).alias("segment"), "body")


@query("w07_one_stream", """with i as (select o_orderkey as id, o_orderkey * 3 as low, o_orderkey * 3 + o_custkey % 7 as high from orders),
o as (select *, max(high) over (order by low, high, id rows between unbounded preceding and 1 preceding) as before from i),
n as (select *, sum(case when before is null or low > before + 1 then 1 else 0 end) over (order by low, high, id rows unbounded preceding) as island from o)
select min(low) as low, max(high) as high, count(*) as n from n group by island""")
def _(s, d):
    low = F.col("o_orderkey") * 3
    intervals = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), low.alias("low"), (low + F.col("o_custkey") % 7).alias("high"))
    return S.merge_intervals(intervals, [], "low", "high", "id").select("low", "high", "n")


@query("w20_one_stream", """with m as (select o_orderkey, o_orderpriority, o_orderstatus <> 'F' and lead(o_orderpriority) over (order by o_orderkey) is not null as joins from orders),
c as (select *, sum(case when coalesce(pj, false) then 0 else 1 end) over (order by o_orderkey rows unbounded preceding) as chain from (select *, lag(joins) over (order by o_orderkey) as pj from m))
select min(o_orderkey) as o_orderkey, string_agg(o_orderpriority, ' ' order by o_orderkey) as text, count(*) as parts from c group by chain""")
def _(s, d):
    return S.join_with_next(table(s, d, "orders"), [], "o_orderkey", "o_orderpriority", F.col("o_orderstatus") != "F").select("o_orderkey", F.col("o_orderpriority").alias("text"), "parts")


@query("q02_one_stream", """select o_orderkey from (select o_orderkey, o_totalprice as k, max(o_totalprice) over (order by o_orderkey rows between unbounded preceding and 1 preceding) as before from orders)
where before is null or k >= before""")
def _(s, d):
    return S.running_max_accept(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [], ["o_orderkey"], "o_totalprice").select("o_orderkey")
