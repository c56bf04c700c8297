"""The engine's tables as views over the star-schema tables, in Spark and in DuckDB.

Texts are addressed as (translation, book, chapter, verse); documents stand for them, one line a verse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search_index import Index, stored
from ..sources.places import shared_folder


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    line = docs.select("lang", "source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return line.where(F.trim("line") != "").select(
        F.col("lang").alias("translation"),
        F.col("source").alias("book"),
        F.substring("source", 4, 9).try_cast("int").alias("book_order"),
        F.col("doc_id").alias("chapter"),
        (F.col("at") + 1).cast("string").alias("verse"),
        (F.col("at") + 1).cast("int").alias("verse_no"),
        F.col("line").alias("text"),
    )


def lessons(spark: SparkSession, d: str) -> DataFrame:
    """The units again, with ten consecutive chapters a book; books have names of letters."""
    number = F.floor(F.col("chapter") / 10)
    name = F.concat(F.lit("b"), F.translate(number.cast("string"), "0123456789", "abcdefghij"))
    return units(spark, d).select("translation", name.alias("book"), number.cast("int").alias("book_order"), (F.col("chapter") % 10 + 1).alias("chapter"), "verse", "verse_no", "text")


def notes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    sv = F.col("p_partkey") % 5
    sc = 1 + F.col("p_partkey") % 4
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("source_id"),
        (F.col("p_partkey") % 20).cast("int").alias("book_order"),
        sc.cast("int").alias("sc"),
        sv.cast("int").alias("sv"),
        (sc + (F.col("p_partkey") % 11 == 0).cast("int")).cast("int").alias("ec"),
        F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(sv + F.col("p_size") % 3).cast("int").alias("ev"),
        F.col("p_name").alias("text"),
    )


def keys(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 20).cast("int").alias("book_order"), (1 + F.col("l_partkey") % 6).cast("int").alias("ch"), F.col("l_linenumber").cast("int").alias("v")).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("head"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("ref"))


def lex(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("H"), F.lpad((F.col("p_partkey") % 500).cast("string"), 4, "0")).alias("number"), F.col("p_brand").alias("source_id"), F.col("p_name").alias("definition"), F.col("p_type").alias("gloss"))


def lex_src(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select(F.col("p_brand").alias("source_id")).distinct()
    return own.unionByName(spark.createDataFrame([("unused",)], "source_id string")).withColumn("rights", F.when(F.col("source_id") == "unused", "none").otherwise("public domain"))


def liturgy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("office"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text")


def words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    w = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("at", "word"))
    return w.select("doc_id", (F.col("at") + 1).cast("long").alias("position"), "word", (F.length("word") % 7 == 0).cast("int").alias("is_variant"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(F.col("event_id").alias("dev_id"), F.col("user_id").alias("ch"), k.alias("vs"), (k + F.col("event_id") % 4).alias("ve"), F.col("event_type").alias("source_id"))


def checkins(spark: SparkSession, d: str) -> DataFrame:
    return checkins_of(table(spark, d, "events"))


def checkins_of(events: DataFrame) -> DataFrame:
    e = events.where("event_type = 'purchase'")
    return e.select((F.col("user_id") % 4).alias("plan_id"), F.lit("2024-01-01").alias("start_date"), (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("day"), F.col("ts").alias("checked_at"), "event_id")


def index(spark: SparkSession, d: str) -> Index:
    """The stored search index of the documents; built when there is none of their present state."""
    return stored(table(spark, d, "documents").select("doc_id", "text"), shared_folder(spark))


def formed(spark: SparkSession, d: str, *forms: Column) -> DataFrame:
    """The parts with ``raw``, one of the forms by p_partkey; forms may use k and n (numbers), w1 and w2 (words), b and c (a book and its name)."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(forms)).alias("form"), (F.col("p_partkey") % 37 + 1).alias("k"), F.col("p_size").cast("long").alias("n"), F.split("p_name", " ").alias("w"))
    p = p.select("p_partkey", "form", "k", "n", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"), F.element_at(F.lit(FORMED_BOOKS), (F.col("k") % len(FORMED_BOOKS) + 1).cast("int")).alias("b"))
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        raw = F.when(F.col("form") == i, form).otherwise(raw)
    return p.withColumn("raw", raw)


#: Books that formed texts name.
FORMED_BOOKS = ["Genesis", "Ruth", "2 Kings", "Psalms", "Isaiah", "Luke", "1 John"]


def roman_of(n: Column, small: bool = True) -> Column:
    """Roman numeral of a number below 4000."""
    units_ = "i ii iii iv v vi vii viii ix".split()
    digit = lambda place, ones: F.element_at(F.lit(["", *(p.translate(str.maketrans("ivx", ones)) for p in units_)]), (F.floor(n / place) % 10 + 1).cast("int"))
    numeral = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(100, "cdm"), digit(10, "xlc"), digit(1, "ivx"))
    return numeral if small else F.upper(numeral)


SQL = {
    "units": """select lang as translation, source as book, try_cast(substr(source, 4, 9) as int) as book_order, doc_id as chapter, cast(pos as varchar) as verse, cast(pos as int) as verse_no, line as text
        from (select lang, source, doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as pos from (select *, string_split(text, chr(10)) as l from documents)) where trim(line) <> ''""",
    "lessons": """select translation, 'b' || translate(cast(chapter // 10 as varchar), '0123456789', 'abcdefghij') as book, cast(chapter // 10 as int) as book_order, chapter % 10 + 1 as chapter, verse, verse_no, text from units""",
    "formed": "select p_partkey, p_partkey % 37 + 1 as k, cast(p_size as bigint) as n, split_part(p_name, ' ', 1) as w1, split_part(p_name, ' ', 2) as w2, (['Genesis', 'Ruth', '2 Kings', 'Psalms', 'Isaiah', 'Luke', '1 John'])[(p_partkey % 37 + 1) % 7 + 1] as b from part",
    "notes": """select p_partkey as id, p_brand as source_id, cast(p_partkey % 20 as int) as book_order, cast(1 + p_partkey % 4 as int) as sc, cast(p_partkey % 5 as int) as sv,
        cast(1 + p_partkey % 4 + (case when p_partkey % 11 = 0 then 1 else 0 end) as int) as ec, cast(case when p_partkey % 7 = 0 then 0 else p_partkey % 5 + p_size % 3 end as int) as ev, p_name as text from part""",
    "keys": "select distinct cast(l_suppkey % 20 as int) as book_order, cast(1 + l_partkey % 6 as int) as ch, cast(l_linenumber as int) as v from lineitem",
    "edges": "select l_orderkey as head, l_linenumber as line, l_partkey as ref from lineitem",
    "lex": "select p_partkey as id, 'H' || lpad(cast(p_partkey % 500 as varchar), 4, '0') as number, p_brand as source_id, p_name as definition, p_type as gloss from part",
    "lex_src": "select distinct p_brand as source_id, 'public domain' as rights from part union all select 'unused', 'none'",
    "liturgy": "select conv_id as office, turn as seq, role as speaker, text from conversations",
    "words": """select doc_id, cast(pos as bigint) as position, word, cast(length(word) % 7 = 0 as int) as is_variant from
        (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents))""",
    "anchors": """select event_id as dev_id, user_id as ch, try_cast(json_extract_string(props, '$.k') as bigint) as vs, try_cast(json_extract_string(props, '$.k') as bigint) + event_id % 4 as ve, event_type as source_id from events""",
    "checkins": "select user_id % 4 as plan_id, '2024-01-01' as start_date, cast(date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as bigint) as day, ts as checked_at, event_id from events where event_type = 'purchase'",
    "tokens": """select doc_id, lang, unnest(w) as term, unnest(range(0, len(w))) as pos from (select doc_id, lang, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') as w from documents)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query; its DuckDB form may use the named views."""

    def wrap(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _with(views, sql)
        return run

    return wrap


def _with(views: str, sql: str) -> str:
    own = ", ".join(f"{v} as ({SQL[v]})" for v in views.split())
    sql = sql.strip()
    if not own:
        return sql
    return f"with {own}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {own} {sql}"
