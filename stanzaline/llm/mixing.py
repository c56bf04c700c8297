"""Mixing sources to target weights.

Every source gets a target number of words. Its documents are ordered by hash-random keys, in buckets
that are ranges of the keys. Prefix sums of the buckets' totals, first over coarse ones and then inside
one of these, say in which bucket the source's budget ends; a running sum inside that bucket alone cuts
it exactly. All other documents lie before or behind the cut as a whole, so they are neither shuffled nor
sorted. A target above the source's size repeats whole epochs first.

Defined cases: a null or empty text has size 0 and is taken for nothing; a null source is a source of
its own, the last one; keys are hashes of doc_id and text, so null and repeated doc_ids are spread like
any others; equal rows are separate documents that tie, and it does not matter which of them is cut; a
very long text is one document that the cut may divide; an empty table gives no rows. All columns of the
input stay as they are; those of the result that would clash with one get underscores in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = 20240511
#: Rows that one bucket of the prefix sums is meant to hold.
BUCKET_ROWS = 1024
#: Buckets that one coarse bucket holds.
COARSE = 4096
#: Sources whose cuts are broadcast: a row of about 60 bytes for each. The cuts of more sources are joined by a shuffle, in which the rows of a large source are dealt to several tasks.
MOST_BROADCAST = 100_000
_KEY_BITS = 40


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = SHARE, most: float = MOST_EPOCHS) -> list[float]:
    """Targets by weight that stop at ``most`` times a source's size; the excess is reshared by weight."""
    caps = [most * s for s in sizes]
    left, open_, found = min(share * sum(sizes), sum(caps)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= caps[i]}
        for i in full or open_:
            found[i] = caps[i] if full else left * weights[i] / total
        if not full:
            break
        left = max(0.0, left - sum(caps[i] for i in full))
        open_ -= full
    return found


def source_targets(totals: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> list[tuple[str | None, int, float]]:
    """(source, size, target), sources by code point with null last; weights repeat in that order."""
    order = sorted(totals, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    own = [float(weights[i % len(weights)]) for i in range(len(order))]
    return [(s, n, t) for (s, n), t in zip(order, targets([n for _, n in order], own, share, most))]


def _bucket(key, count: int):
    """Number of the key's range, of ``count`` ranges; a product of longs would pass 64 bits from 2^23 ranges on."""
    return (key / F.lit(float(1 << _KEY_BITS)) * F.lit(float(count))).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = SEED, whole_documents: bool = False) -> DataFrame:
    """The documents with mix_size, mix_source_size, mix_target and mix_taken (words taken, repeats counted).

    With ``whole_documents`` the document at the cut is taken whole if half of it fits, else left;
    otherwise it is taken up to the cut, so that a source's words add up to its target, rounded.
    """
    own, spark = docs.columns, docs.sparkSession
    size, source_size, target, taken = common.fresh(own, "mix_size", "mix_source_size", "mix_target", "mix_taken")
    key, copy, bucket, within = common.fresh(own, "mix_key", "mix_copy", "mix_bucket", "mix_within")
    count = max(1, -(-docs.select(F.lit(1)).count() // BUCKET_ROWS))
    rows = docs.withColumn(copy, F.xxhash64("text")).withColumn(key, F.shiftrightunsigned(F.xxhash64("doc_id", copy, F.lit(seed)), 64 - _KEY_BITS))
    # a bucket is a range of keys, and keys are uniform: no sampling, and a hot source has as many buckets as it needs
    rows = rows.withColumn(bucket, _bucket(F.col(key), count)).withColumn(size, common.word_count(F.col("text")))
    sums = common.materialize(rows.groupBy("source", F.col(bucket).alias("bucket")).agg(F.sum(size).alias("words"), F.count("*").alias("n")), "mix")
    # one row for each source: a list of the corpus's sources, not of its documents
    wanted = source_targets([(r["source"], r["words"]) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()], weights, share, most)
    goals = []
    for source, n, goal in wanted:
        epochs = round(goal) // n if n else 0
        goals.append((source, n, float(goal), epochs, round(goal) - epochs * n))
    cuts = _cuts(sums, goals)
    named = {"of": "mix_of", "size": "mix_of_size", "target": "mix_of_target", "epochs": "mix_epochs", "left": "mix_left", "cut": "mix_cut"}
    named = dict(zip(named, common.fresh([*rows.columns, source_size, target, taken, within], *named.values())))
    few = len(cuts) <= MOST_BROADCAST
    cuts = spark.createDataFrame(cuts, ", ".join(f"{named[c]} {t}" for c, t in zip(named, ("string", "long", "double", "long", "long", "long"))))
    of, of_size, of_target, epochs, left, cut = (F.col(c) for c in named.values())
    if few:
        met = rows.join(F.broadcast(cuts), F.col("source").eqNullSafe(of))
    else:
        (n,) = common.fresh([*rows.columns, *named.values()], "mix_n")
        counted = sums.groupBy("source").agg(F.sum("n").alias(n))
        cuts = cuts.join(counted, of.eqNullSafe(F.col("source"))).drop("source")
        # in a struct a null source is a key like any other
        met = common.spread_join(rows.withColumn(within, F.struct("source")), cuts.withColumn(within, F.struct(of.alias("source"))), within, copy, n).drop(within)
    out = [*(F.col(c) for c in own), F.col(size), of_size.alias(source_size), of_target.alias(target)]
    outside = met.where(F.col(bucket) != cut).select(*out, ((epochs + (F.col(bucket) < cut).cast("long")) * F.col(size)).alias(taken))
    # what is left of a source's budget at the start of its cut bucket, whose rows alone are sorted
    order = Window.partitionBy("source").orderBy(key, "doc_id", copy).rowsBetween(Window.unboundedPreceding, -1)
    inside = met.where(F.col(bucket) == cut).withColumn(within, left - F.coalesce(F.sum(size).over(order), F.lit(0)))
    part = F.when(F.col(within) * 2 >= F.col(size), F.col(size)).otherwise(0) if whole_documents else F.greatest(F.lit(0), F.least(F.col(size), F.col(within)))
    return outside.unionAll(inside.select(*out, (epochs * F.col(size) + part).cast("long").alias(taken)))


def _cuts(sums: DataFrame, goals: list[tuple]) -> list[tuple]:
    """Each source's (of, size, target, epochs, left, cut): the bucket in which its budget ends (-1: at an epoch's end), and what is left of it there."""
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.sparkSession.createDataFrame(goals, "of string, size long, target double, epochs long, left long")

    def descend(level: DataFrame, into: DataFrame) -> DataFrame:
        placed = level.join(into, level["source"].eqNullSafe(into["of"])).withColumn("left", F.col("left") - F.coalesce(F.sum("words").over(before), F.lit(0)))
        return placed.where("left >= 0 and left < words").select(*into.columns, "at")

    # prefix sums over coarse buckets, then over the buckets of the one in which the budget ends
    coarse = sums.withColumn("at", F.floor(F.col("bucket") / COARSE)).groupBy("source", "at").agg(F.sum("words").alias("words"))
    top = descend(coarse, known).withColumnRenamed("at", "coarse")
    fine = sums.withColumnRenamed("bucket", "at")
    of_top = fine.join(top.select(F.col("of").alias("top_of"), "coarse"), F.col("source").eqNullSafe(F.col("top_of")) & (F.floor(F.col("at") / COARSE) == F.col("coarse"))).select("source", "at", "words")
    found = {r["of"]: r for r in descend(of_top, top).collect()}
    out = []
    for *goal, left in goals:
        end = found.get(goal[0]) if left > 0 else None
        out.append((*goal, end["left"] if end else 0, end["at"] if end else -1))
    return out


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as whole documents are taken, with its own columns."""
    own = docs.columns
    size, taken, repeat = common.fresh(own, "mix_size", "mix_taken", "mix_repeat")
    times = F.when(F.col(size) > 0, (F.col(taken) / F.col(size)).cast("int")).otherwise(0)
    return mix(docs, whole_documents=True, **options).withColumn(repeat, F.explode(F.array_repeat(F.lit(0), times))).select(*own)
