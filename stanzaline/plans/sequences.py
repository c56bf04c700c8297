"""Stateful sequence algorithms as registered queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.headers import head_reference
from ..operators import sequences as Q
from . import lens
from .lens import query, table


@query("q01_longest_chain")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("k"))
    return Q.keep_chain(c, ["conv_id"], ["turn"], "k")


def _scanned(s, d):
    """The parts of each brand as a scanned dictionary: numbered entries, some numbers misread, lost or unreadable."""
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    part = table(s, d, "part").select("p_brand", "p_partkey", "p_size", "p_name", at.alias("n"))
    digits = F.col("n").cast("string")
    token = F.when(F.col("p_partkey") % 11 == 3, F.translate(digits, "1358", "lSBS")).when(F.col("p_partkey") % 17 == 5, "~#").when(F.col("p_partkey") % 13 == 7, F.concat(F.lit("."), digits)).otherwise(digits)
    body = F.when(F.col("p_partkey") % 19 == 0, F.lit("no entry at all")).otherwise(F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" "), F.element_at(F.split("p_name", " "), 2), F.lit(", "), F.lit("sound; "), F.col("p_name")))
    return part.where("p_partkey % 23 <> 0").select("p_brand", "p_partkey", F.concat(token, F.lit(". "), body).alias("line"))


@query("q04b_simple")
def _(s, d):
    """The simple machine over the same entries, with and without anchors."""
    heads = _scanned(s, d).withColumn("token", F.regexp_replace(F.regexp_extract("line", r"^(\S+?)[.] ", 1), r"^\.", ""))
    plain = Q.number_headings(heads, "p_brand", "p_partkey", "token", [(10, 12)])
    anchored = Q.number_headings(heads, "p_brand", "p_partkey", "token", [(10, 12)], anchored=True)
    return plain.withColumn("machine", F.lit("plain")).unionByName(anchored.withColumn("machine", F.lit("anchored")))


@query("q05_align")
def _(s, d):
    """Each conversation's turns as verses, phrases of their words aligned to them."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), "[^a-z]+").alias("words"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        verses = [[w for w in row if w] for row in part["words"]]
        phrases = [v[len(v) // 2 : len(v) // 2 + 4] for v in verses]
        found = Q.align_phrases(phrases, verses)
        return pd.DataFrame({"conv_id": part["conv_id"], "turn": part["turn"], "verse": [v for v, _ in found], "strength": [k for _, k in found]})

    return Q.per_group(c, ["conv_id"], ["turn"], run, "conv_id long, turn long, verse long, strength string")


@query("q09_header_groups", """with m as (select chapter, verse_no, length(text) < 80 as head from units), r as (select *, verse_no - row_number() over (partition by chapter, head order by verse_no) as run from m)
select chapter, min(verse_no) as low, max(verse_no) as high from r where head group by chapter, run""", "units")
def _(s, d):
    """Runs of consecutive header lines."""
    from ..operators.windows import islands

    heads = lens.units(s, d).where(F.length("text") < 80)
    return islands(heads, ["chapter"], "verse_no").select("chapter", "low", "high")


@query("q10_fan_out", """select p_partkey, b || ' ' || k || ':1-' || k || ':' || n as ref, w1 || ' ' || w2 as text from formed where p_partkey % 3 >= 0 union all select p_partkey, 'Jude 1:' || n || '-1:' || n, w1 || ' ' || w2 from formed where p_partkey % 3 >= 1
union all select p_partkey, 'Luke ' || k || ':2-' || k + 1 || ':3', w1 || ' ' || w2 from formed where p_partkey % 3 = 2""", "formed")
def _(s, d):
    """One text to each of the references that its head names: one, two or three of them, the last without its book."""
    one, two = F.format_string("%s %d:1-%d", F.upper("b"), "k", "n"), F.format_string("Jude %d", "n")
    heads = [one, F.concat_ws("; ", one, two), F.concat_ws("; ", one, two, F.format_string("%d:2-%d:3.", "k", F.col("k") + 1))]
    each = lens.formed(s, d, *heads).select("p_partkey", F.concat_ws(" ", "w1", "w2").alias("text"), F.explode(F.split("raw", "; ")).alias("head"))
    ref = head_reference(F.col("head"), F.lit("Luke"))
    return each.select("p_partkey", ref.alias("r"), "text").select("p_partkey", F.format_string("%s %d:%d-%d:%d", "r.book", "r.sc", "r.sv", "r.ec", "r.ev").alias("ref"), "text")


@query("q11_blocks")
def _(s, d):
    u = Q.listed(lens.units(s, d), ["chapter"], "verse_no", "text", "own")

    @F.pandas_udf("array<struct<kind: string, sidenote: string>>")
    def blocks(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "sidenote": x} for k, x in Q.classify_blocks(own)] for own in texts], dtype=object)

    found = u.select("chapter", F.posexplode(blocks("own.v")).alias("at", "b"))
    return found.select("chapter", (F.col("at") + 1).cast("long").alias("block"), "b.kind", "b.sidenote")


@query("w17_trigger_sections")
def _(s, d):
    c = lens.liturgy(s, d)
    triggers = [("the", "opening"), ("a", "body"), ("in", "close")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"office": part["office"], "seq": part["seq"], "section": Q.trigger_sections(part["text"].tolist(), triggers)})

    return Q.per_group(c, ["office"], ["seq"], run, "office long, seq long, section string")


@query("j19_fuzzy")
def _(s, d):
    """Notes that quote every third line, spoilt here and there, and are kept if they are like the line that they name, or like the second of its chapter."""
    from ..operators.joins import like_canonical

    u = lens.lessons(s, d).select("translation", "book", "chapter", "verse_no", "text")
    words = F.split("text", " ")
    spoilt = F.array_join(F.transform(words, lambda w, k: F.when((k + F.col("verse_no")) % F.col("verse_no") == 0, F.reverse(w)).otherwise(w)), " ")
    heads = u.where("verse_no % 3 = 2").withColumn("head", spoilt)
    notes = heads.select("translation", "book", "chapter", F.when(F.col("verse_no") == 2, 1).otherwise(F.col("verse_no")).alias("verse_no"), "head")
    found = like_canonical(notes, u, ["translation", "book", "chapter"], "verse_no", "head", "text", 0.4, F.when(F.col("verse_no") == 1, 2))
    return found.select("book", "chapter", "verse_no", "matched", F.round("likeness", 6).alias("likeness"))


@query("j20_phrases")
def _(s, d):
    """Phrases from the middle of every second line, aligned to the lines of their chapter."""
    u = lens.lessons(s, d).select("book", "chapter", "verse_no", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("words"))
    phrases = u.where("verse_no % 2 = 1 and size(words) > 3").select("book", "chapter", F.col("verse_no").alias("seq"), F.slice("words", F.floor(F.size("words") / 2).cast("int"), 4).alias("words"))
    return Q.align_to_verses(phrases, u, ["book", "chapter"], "seq", "verse_no")
