"""Two-phase scans against loops of Python over the sorted rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stanzaline.operators import scans as S

SCHEMA = "g string, o int, t int, v int, _block int, text string"


def made(rng, n, groups):
    """Rows of few groups, one of them with most rows; orders have nulls and ties that t breaks."""
    rows = [(rng.choice(groups), rng.choice([None, *range(n // 3)]), i, rng.choice([None, rng.randrange(500)]), -i, rng.choice([None, "a.", "b", "c"])) for i in range(n)]
    return rows


def by_group(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out[r[0]].append(r)
    return out


@pytest.mark.parametrize("rows", [40, 100_000])
def test_folds(spark, rows):
    rng = random.Random(rows)
    data = made(rng, 3000, ["a", "a", "a", "a", None, "b"]) + [("tiny", 1, -1, 7, 0, "x")]
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    out = S.Blocks(df, ["g"], ["o", "t"], rows).run(
        seen=S.last(F.col("v")), seen_before=S.last(F.col("v"), before=True), top=S.most(F.col("v")), top_before=S.most(F.col("v"), before=True),
        n=S.total(F.lit(1)), n_before=S.total(F.lit(1), before=True), after=S.next_row(F.col("v")),
    ).frame()
    assert out.columns[:6] == df.columns  # extra columns stay, a clashing name too
    got = {r.t: tuple(r)[4:] for r in out.collect()}
    assert len(got) == len(data)
    for own in by_group(data).values():
        last, top, n = None, None, 0
        for k, r in enumerate(own):
            before, top_before = last, top
            if r[3] is not None:
                last, top = r[3], r[3] if top is None else max(top, r[3])
            n += 1
            after = own[k + 1][3] if k + 1 < len(own) else None
            assert got[r[2]] == (r[4], r[5], last, before, top, top_before, n, n - 1, after)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_operators(spark, group):
    rng = random.Random(5)
    data = made(rng, 2500, ["a", "a", "a", None])
    if not group:
        data = [(None, *r[1:]) for r in data]
    df = spark.createDataFrame(data, SCHEMA).repartition(5).withColumn("at", F.struct("o", "t")).withColumn("till", F.col("o") + F.col("t") % 3)
    sets = by_group(data)
    tag = lambda g: (g,) if group else ()
    body = defaultdict(list)
    chains, stays, isles = [], [], []
    for g, own in sets.items():
        segment, parts, first, top, reach, n, low = 0, [], None, None, None, 0, None
        for k, r in enumerate(own):
            segment += r[3] is not None and r[3] % 9 == 0
            body[(*tag(g), segment)] += [r[5]] if r[5] is not None else []
            parts = parts or [0, []]
            first = r[2] if not parts[0] else first
            parts = [parts[0] + 1, parts[1] + ([r[5]] if r[5] is not None else [])]
            more = r[5] is not None and not r[5].endswith(".") and k + 1 < len(own) and own[k + 1][5] is not None
            if not more:
                chains.append((*tag(g), first, " ".join(parts[1]), parts[0]))
                parts = []
            if r[3] is not None and (top is None or r[3] >= top) or top is None:
                stays.append(r[2])
            top = r[3] if top is None else max(top, r[3] or 0)
        for r in sorted((x for x in own if x[1] is not None), key=lambda x: (x[1], x[1] + x[2] % 3, x[2])):
            s, e = r[1], r[1] + r[2] % 3
            if reach is None or s > reach + 1:
                isles += [(*tag(g), low, reach, n)] if n else []
                low, reach, n = s, e, 0
            reach, n = max(reach, e), n + 1
        isles += [(*tag(g), low, reach, n)] if n else []
    run = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    marked = S.segments(df, group, "at", F.coalesce(F.col("v") % 9 == 0, F.lit(False)), "text", rows=64)
    assert run(marked) == sorted(((*k, " ".join(v)) for k, v in body.items()), key=repr)
    joined = S.join_with_next(df, group, "at", "text", ~F.col("text").endswith("."), rows=64)
    assert run(joined.select(*group, "at.t", "text", "parts")) == sorted(chains, key=repr)
    assert sorted(r.t for r in S.running_max_accept(df, group, ["o", "t"], "v", rows=64).collect()) == sorted(stays)
    known = df.where("o is not null")
    assert run(S.merge_intervals(known, group, "o", "till", "t", rows=64)) == sorted(isles, key=repr)


def test_one_group_is_many_even_tasks(spark):
    """One file of 64,000 rows: its blocks, and so the tasks, hold about a sixteenth each; the plan has no window over it all."""
    df = spark.range(64_000).select((F.col("id") * 7919 % 64_000).alias("line"))
    blocks = S.Blocks(df, [], ["line"], 4000)
    sizes = [r["count"] for r in blocks.df.groupBy(blocks.block).count().collect()]
    assert len(sizes) >= 12 and sum(sizes) == 64_000 and max(sizes) <= 2.2 * 4000
    out = blocks.run(n=S.total(F.lit(1))).frame()
    assert out.where("n != line + 1").count() == 0 and out.count() == 64_000


def test_empty_tied_and_many_groups(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.number(df, ["g"], ["o", "t"], rows=1).count() == 0
    tied = spark.range(500).select(F.lit(1).alias("o"), F.col("id").alias("v"))
    assert sorted(r.n for r in S.number(tied, [], ["o"], rows=20).collect()) == list(range(1, 501))
    many = spark.range(4000).select((F.col("id") % 1000).alias("g"), "id")
    assert S.number(many, ["g"], ["id"], rows=50).groupBy("n").count().collect().__len__() == 4
