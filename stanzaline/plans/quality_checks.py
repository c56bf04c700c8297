"""Lifecycle and audit operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import hash_tree as H
from ..operators import joins as J
from ..operators import lifecycle as L
from ..sources.places import fresh_folder
from ..sources.versions import VersionedTable
from . import lens
from .lens import query, table
from .texts import LESSONS_SQL, _lesson_parsed


def _changes(s, d):
    return table(s, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("id"), F.lit("patched").alias("text"), (F.col("p_partkey") % 3).cast("int").alias("ec"))


@query("l01_patch", "select id, case when id % 10 = 3 then 'patched' else text end as text, case when id % 10 = 3 then cast(id % 3 as int) else ec end as ec from notes", "notes")
def _(s, d):
    return L.patch(lens.notes(s, d), _changes(s, d), "id").select("id", "text", "ec")


@query("l02_delete", "select id from notes where id % 10 <> 3", "notes")
def _(s, d):
    return L.delete(lens.notes(s, d), _changes(s, d), "id").select("id")


@query("l03_recover", "select id, text from notes union all select l_orderkey + 1000000, 'recovered' from lineitem where l_linenumber = 1 and l_quantity = 50", "notes")
def _(s, d):
    found = table(s, d, "lineitem").where("l_linenumber = 1 and l_quantity = 50").select((F.col("l_orderkey") + 1000000).alias("id"), F.lit("recovered").alias("text"))
    return lens.notes(s, d).select("id", "text").unionByName(found)


@query("l04_preconditions", "select id from notes where id % 10 = 3 and not (text = 'patched' and ec = id % 3)", "notes")
def _(s, d):
    return L.unmet(lens.notes(s, d), _changes(s, d), "id")


@query("l05_dry_run", "select count(*) filter (where id % 10 = 3) as patched, count(*) as rows from notes", "notes")
def _(s, d):
    """A change is written as a draft, looked at, and not committed: the table keeps its one version."""
    store = VersionedTable(s, fresh_folder(s, "dry-run"))
    store.append(lens.notes(s, d)).commit()
    draft = store.replace(L.patch(store.read(), _changes(s, d), "id"))
    still = store.read().agg(F.count_if(F.col("text") == "patched").alias("before"))
    after = draft.read().agg(F.count_if(F.col("text") == "patched").alias("patched"), F.count("*").alias("rows"))
    return after.join(F.broadcast(still)).select((F.col("patched") - F.col("before")).alias("patched"), "rows")


@query("l06_protected", "select id from notes where id % 10 = 3", "notes")
def _(s, d):
    before = lens.notes(s, d)
    return L.changed(before, L.patch(before, _changes(s, d), "id"), "id", "text")


@query("l08_completed_days", "select plan_id, string_agg(cast(day as varchar), ',' order by day) as days from (select distinct plan_id, day from checkins) group by plan_id", "checkins")
def _(s, d):
    once = L.last_wins(lens.checkins(s, d), ["plan_id", "start_date", "day"], ["checked_at", "event_id"])
    return once.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("day")), lambda x: x.cast("string")), ",").alias("days"))


@query("v01_reconcile", "select 'scan' as stage, count(*) as n from part union all select 'notes', count(*) from notes union all select 'lex', count(*) from lex", "notes lex")
def _(s, d):
    return A.reconcile({"scan": table(s, d, "part"), "notes": lens.notes(s, d), "lex": lens.lex(s, d)})


@query("v02_leak_scan", r"""select 'tag' as pattern, count(*) filter (where regexp_matches(html, '<[^>]+>')) as n from pages union all select 'entity', count(*) filter (where regexp_matches(html, '&[a-zA-Z]+;|&#[0-9]+;')) from pages
union all select 'marker', count(*) filter (where regexp_matches(html, '\\[a-z]+')) from pages union all select 'brace', count(*) filter (where regexp_matches(html, '\{\{|\}\}')) from pages""")
def _(s, d):
    return A.leaks(table(s, d, "pages"), "html")


@query("v03_order", "select distinct book, book_order from units where book in ('src4', 'src5')", "units")
def _(s, d):
    """Against a canon in which two books have changed places."""
    canon = [f"src{i}" for i in (0, 1, 2, 3, 5, 4, *range(6, 20))]
    return A.out_of_order(lens.units(s, d), "book", "book_order", canon)


@query("v04_duplicates", "select lang, md5(text) as h, count(*) as n from documents group by all having count(*) > 1")
def _(s, d):
    """Texts that a language has more than once."""
    return A.duplicates(table(s, d, "documents").select("lang", F.md5("text").alias("h")), ["lang", "h"])


@query("v05_raw_to_table", "with d as (select doc_id, length(replace(text, chr(10), '')) as n from documents), u as (select chapter, sum(length(text)) as n from units where verse_no <> 3 group by chapter) select d.doc_id from d left join u on u.chapter = d.doc_id where coalesce(u.n, 0) <> d.n", "units")
def _(s, d):
    """Raw documents whose stored lines, without the third of each, are not all of them."""
    raw = table(s, d, "documents").select("doc_id", F.length(F.replace("text", F.lit("\n"), F.lit(""))).alias("raw"))
    stored = lens.units(s, d).where("verse_no <> 3").groupBy(F.col("chapter").alias("doc_id")).agg(F.sum(F.length("text")).alias("n"))
    return raw.join(stored, "doc_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("raw")).select("doc_id")


@query("v06_prefix", "select doc_id from documents where len(text) > 0 and not contains(substring(text, 201), substring(text, 1 + cast(doc_id % 3 as int) * 150, 40))")
def _(s, d):
    """Stored beginnings, from three places of the text, that the raw text from its 201st character on does not hold."""
    docs = table(s, d, "documents").where("length(text) > 0")
    stored = docs.select("doc_id", F.substring("text", 1 + (F.col("doc_id") % 3).cast("int") * 150, F.lit(40)).alias("text"))
    return A.starts_within(docs.select("doc_id", F.substring("text", F.lit(201), F.length("text")).alias("raw")), stored, "doc_id", "raw", "text")


@query("v07_refs_resolve", "with " + LESSONS_SQL + " select of, form, error from f where error is not null", "units lessons")
def _(s, d):
    """References that do not resolve, of all forms to all books."""
    return A.unresolved(_lesson_parsed(s, d)).select("of", "form", "error")


@query("v08_traceable", "select distinct source_id from notes where source_id not in ('Brand#11', 'Brand#12')", "notes")
def _(s, d):
    listed = s.createDataFrame([("Brand#11",), ("Brand#12",)], "source_id string")
    return A.untraced(lens.notes(s, d), "source_id", listed)


@query("v09_neighbours", """with h as (select distinct book_order, ch from keys), m as (select book_order, ch from h where ch = 3)
select m.book_order, m.ch as missing, h.ch from m join h on h.book_order = m.book_order and h.ch between m.ch - 1 and m.ch + 1""", "keys")
def _(s, d):
    have = lens.keys(s, d).select("book_order", "ch").distinct()
    return A.neighbours(have, have.where("ch = 3"), ["book_order"], "ch")


@query("v10_coverage", "select book, chapter, count(*) as n from units group by all", "units")
def _(s, d):
    return A.coverage(lens.units(s, d), ["book", "chapter"])


@query("v11_equal_derivations", """with a as (select id, text from notes where id % 5 <> 0), b as (select id, case when id % 7 = 0 then 'other' else text end as text from notes where id % 3 <> 0)
select coalesce(a.id, b.id) as id, case when b.id is null then 'only left' when a.id is null then 'only right' else 'differs' end as kind from a full join b on a.id = b.id where b.id is null or a.id is null or a.text <> b.text""", "notes")
def _(s, d):
    n = lens.notes(s, d).select("id", "text")
    b = n.where("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("text")))
    return J.differences(n.where("id % 5 <> 0"), b, ["id"], "text")


_TWO_SQL = """with a as (select o_orderkey, o_custkey, case when o_orderkey % 997 = 5 then 'other' else o_orderpriority end as p from orders where o_orderkey % 1013 <> 7), b as (select o_orderkey, o_custkey, o_orderpriority as p from orders where o_orderkey % 1009 <> 3)
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'only left' when a.o_orderkey is null then 'only right' else 'differs' end as kind
from a full join b on a.o_orderkey = b.o_orderkey where b.o_orderkey is null or a.o_orderkey is null or a.p <> b.p"""


def _two_orders(s, d):
    """Two derivations of the orders that differ in few rows."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("p"))
    a = o.where("o_orderkey % 1013 <> 7").withColumn("p", F.when(F.col("o_orderkey") % 997 == 5, "other").otherwise(F.col("p")))
    return a, o.where("o_orderkey % 1009 <> 3")


@query("v11_hash_tree", _TWO_SQL)
def _(s, d):
    """Sums of hashes by leaf first; rows of leaves that differ alone are joined."""
    return H.differences(*_two_orders(s, d), ["o_orderkey"], ["o_custkey", "p"])


@query("v11_stored_trees", _TWO_SQL)
def _(s, d):
    """The same with both tables stored beside their trees, which are compared from the root down."""
    schema, stored = "o_orderkey bigint, o_custkey bigint, p string", []
    for rows in _two_orders(s, d):
        path = fresh_folder(s, "hash-tree")
        H.store(rows.selectExpr("cast(o_orderkey as bigint) o_orderkey", "cast(o_custkey as bigint) o_custkey", "p"), ["o_orderkey"], path, folders=1)
        stored.append(H.Stored(s, path, schema, folders=1))
    return H.stored_differences(*stored, ["o_orderkey"], ["o_custkey", "p"])


@query("t02_hash_tree", "select o_orderkey, p from (select o_orderkey, case when o_orderkey % 997 = 5 then 'other' else o_orderpriority end as p from orders where o_orderkey % 1013 <> 7) except select o_orderkey, o_orderpriority from orders where o_orderkey % 1009 <> 3")
def _(s, d):
    """Set difference in which rows of equal leaves take no part."""
    return H.left_only(*(df.select("o_orderkey", "p") for df in _two_orders(s, d)))


@query("v12_gaps", """with m as (select distinct l_suppkey, l_partkey from lineitem), n as (select *, lead(l_partkey) over (partition by l_suppkey order by l_partkey) as nx from m)
select l_suppkey, l_partkey + 1 as low, nx - 1 as high from n where nx > l_partkey + 1""")
def _(s, d):
    return A.gaps(table(s, d, "lineitem"), ["l_suppkey"], "l_partkey")
