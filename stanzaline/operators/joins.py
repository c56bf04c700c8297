"""Joins of keys, spans, notes and sources.

Every join has an equality to shuffle on; ranges are residual conditions or are turned into equalities
by their dyadic covers, so none plans as a nested loop. Sides are broadcast only by Spark's own
size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covers(ch, v, sc="sc", sv="sv", ec="ec", ev="ev") -> Column:
    """A note's range holds a verse, in the order of (chapter, verse); 0 opens a chapter's start or end."""
    ch, v, sc, sv, ec, ev = (F.col(x) if isinstance(x, str) else x for x in (ch, v, sc, sv, ec, ev))
    return ((sc < ch) | ((sc == ch) & ((sv == 0) | (sv <= v)))) & ((ec > ch) | ((ec == ch) & ((ev == 0) | (ev >= v))))


def dyadic_cover(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each row once for every block of its interval's cover: the fewest blocks of 2^_level numbers that begin at a multiple of their size, _block.

    An interval of n numbers has at most 2 log2(n) blocks, and each of its numbers lies in one of them. An
    interval whose end lies before its beginning, or is null, has none.
    """
    sized = rows.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).where("_low <= _high")
    levels = F.explode(F.sequence(F.lit(0), F.floor(F.log2((F.col("_high") - F.col("_low") + 1).cast("double"))).cast("int")))
    level = sized.withColumn("_level", levels)
    # whole blocks of the level lie from _left to before _right; the next level takes them but for an odd one at either end
    ends = level.withColumns({"_left": F.expr("shiftright(_low + shiftleft(1L, _level) - 1, _level)"), "_right": F.expr("shiftright(_high + 1, _level)")})
    first = F.when((F.col("_left") % 2 != 0) & (F.col("_left") < F.col("_right")), F.col("_left"))
    last = F.when((F.col("_right") % 2 != 0) & (F.col("_left") + F.abs(F.col("_left") % 2) < F.col("_right")), F.col("_right") - 1)
    return ends.withColumn("_block", F.explode(F.array(first, last))).where("_block is not null").drop("_low", "_high", "_left", "_right")


def meet_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: Column, high: Column) -> DataFrame:
    """Points with the intervals (from ``low`` to ``high``, both included) of their keys that they lie in.

    An interval is as many rows as its dyadic cover has blocks, however long it is; a point is one for each
    level up to the length of the longest interval. Both meet on an equality, every pair once.
    """
    covered = dyadic_cover(intervals, low, high)
    # one number; blocks of an interval are no longer than it
    longest = intervals.agg(F.max(high.cast("long") - low.cast("long") + 1).alias("n")).first()["n"] or 0
    levels = list(range(max(0, longest).bit_length()))
    spread = points.withColumn("_level", F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>"))).withColumn("_block", F.expr(f"shiftright(cast(`{at}` as bigint), _level)"))
    return spread.join(covered, [*keys, "_level", "_block"]).drop("_level", "_block")


def covering_notes(keys: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that cover each key (book_order, ch, v): the intervals of chapters that hold it, the verses of the first and last a residual."""
    return meet_intervals(keys, notes, ["book_order"], "ch", F.col("sc"), F.col("ec")).where(covers("ch", "v"))


def overlap_tiers(keys: DataFrame, anchors: DataFrame, slack: int = 3) -> DataFrame:
    """Anchors at each key (ch, v) of the best tier only: 0 covers the verse, 1 lies within ``slack`` of it."""
    met = meet_intervals(keys, anchors.where("vs <= ve"), ["ch"], "v", F.col("vs") - slack, F.col("ve") + slack)
    tier = F.when((F.col("vs") <= F.col("v")) & (F.col("ve") >= F.col("v")), 0).otherwise(1)
    best = F.min("tier").over(Window.partitionBy("ch", "v"))
    return met.withColumn("tier", tier).withColumn("best", best).where("tier = best").drop("best")


def resolve_passages(refs: DataFrame, units: DataFrame, position: str = "ref_ix") -> DataFrame:
    """Verses of parsed references (book, spans), kept in the order of reference, span and verse.

    Spans are unfolded with their position; the equality is on book and chapter, the verse a residual.
    """
    spans = refs.where("error is null").select(position, "book", F.posexplode("spans").alias("span_ix", "span"))
    spans = spans.select(position, "book", "span_ix", F.col("span.ch").cast("long").alias("chapter"), "span.vs", "span.ve")
    met = spans.join(units, ["book", "chapter"]).where(F.col("verse_no").between(F.col("vs"), F.col("ve")))
    return met.select(position, "span_ix", "translation", "book", "chapter", "verse_no", "text")


def side_by_side(units: DataFrame, codes: list[str], keys: list[str]) -> DataFrame:
    """A row for every key that any of the codes has, a column for each code's text: one aggregation."""
    return units.where(F.col("translation").isin(codes)).groupBy(*keys).pivot("translation", codes).agg(F.min("text"))


def presence(codes: DataFrame, units: DataFrame, **key) -> DataFrame:
    """For each code the text at one key, and whether it has any."""
    at = units
    for name, value in key.items():
        at = at.where(F.col(name) == value)
    met = codes.join(at.select("translation", "text"), "translation", "left")
    return met.select("translation", "text", F.col("text").isNotNull().alias("present"))


def with_counts(sources: DataFrame, rows: DataFrame, key: str, counted: str) -> DataFrame:
    """Each source with the number of its rows, zero included; rows are counted before the join."""
    counts = rows.groupBy(key).agg(F.count(counted).alias("n"))
    return sources.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def first_by_priority(rows: DataFrame, key: str, source: str, order: list[str], value: str, tie: str) -> DataFrame:
    """Per key the value of the first source in ``order``; within a source the least ``tie``."""
    rank = F.array_position(F.lit(order), F.col(source))
    known = rows.where(F.col(source).isin(order))
    return known.groupBy(key).agg(F.min_by(F.struct(F.col(source), F.col(value)), F.struct(rank, F.col(tie))).alias("best")).select(key, f"best.{source}", f"best.{value}")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.join(parents, rows[key] == parents[parent_key], "left_anti")


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    only_a = a.select(*keys).distinct().join(b, keys, "left_anti").withColumn("side", F.lit("left"))
    only_b = b.select(*keys).distinct().join(a, keys, "left_anti").withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)


def like_canonical(notes: DataFrame, verses: DataFrame, keys: list[str], verse: str, head: str, text: str, least: float = 0.25, other: Column | None = None) -> DataFrame:
    """Notes (keys, verse, head) whose head is like the verse of their key, with the likeness and the verse that it is of.

    A note has one candidate, the verse of its own key, so nothing is compared with more than one row; where
    ``other`` holds (a column of the notes) and the first is not alike, the verse of that number is the second.
    Beginnings are compared by letters and digits alone; equal notes are one.
    """
    from ..functions.scalars import similarity

    bare = lambda c, n: F.regexp_replace(F.lower(F.substring(c, 1, n)), "[^a-z0-9]", "")
    own = verses.select(*keys, F.col(verse).alias("_verse"), bare(F.col(text), 80).alias("_text"))
    tried = notes.withColumn("_head", bare(F.col(head), 150)).withColumn("_verse", F.explode(F.array_distinct(F.array(verse, F.coalesce(other, F.col(verse)) if other is not None else verse))))
    met = tried.join(own, [*keys, "_verse"]).withColumn("likeness", similarity("_text", "_head")).where(F.col("likeness") >= least)
    first = F.struct(F.col("_verse") != F.col(verse), "likeness", F.col("_verse").alias("matched"))
    best = met.groupBy(*notes.columns).agg(F.min(first).alias("_best"))
    return best.select(*notes.columns, F.col("_best.matched").alias("matched"), F.col("_best.likeness").alias("likeness"))


def zip_by_order(a: DataFrame, b: DataFrame, group: str, a_order: str, b_order: str) -> DataFrame:
    """Joins the n-th row of each group on one side with the n-th on the other; a side that runs out is null."""
    number = lambda df, o: df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(o)))
    return number(a, a_order).join(number(b, b_order), [group, "n"], "full")


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ, or that one side lacks: full outer, null-safe."""
    met = a.select(*keys, F.col(value).alias("a_value"), F.lit(1).alias("in_a")).join(b.select(*keys, F.col(value).alias("b_value"), F.lit(1).alias("in_b")), keys, "full")
    kind = F.when(F.col("in_b").isNull(), "only left").when(F.col("in_a").isNull(), "only right").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "differs")
    return met.withColumn("kind", kind).where("kind is not null").select(*keys, "kind")
