"""Bitmap sets against sets of Python."""

import random

from stanzaline.operators import number_sets as N


def test_sets(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice("xy"), rng.choice([rng.randrange(-40_000, 100_000), rng.randrange(50), None])) for _ in range(3000)] + [("c", "x", None)]
    df = spark.createDataFrame(rows, "k string, day string, v int").repartition(6)
    wanted = {}
    for k, day, v in rows:
        wanted.setdefault((k, day), set()).update([] if v is None else [v])
    sets = N.build(df, ["k", "day"], "v")
    assert {(r.k, r.day): r.n for r in N.count(sets, ["k", "day"]).collect()} == {k: len(v) for k, v in wanted.items()}
    merged = {k: set().union(*(v for own, v in wanted.items() if own[0] == k)) for k in "abc"}
    assert {r.k: r.n for r in N.count(sets, ["k"]).collect()} == {k: len(v) for k, v in merged.items()}
    for low, high in ((-5, 60), (32_760, 32_775), (-32_770, -32_760), (1, 40)):
        got = sorted((r.k, r.v) for r in N.missing(sets, ["k"], low, high, "v").collect())
        assert got == sorted((k, n) for k, v in merged.items() for n in range(low, high + 1) if n not in v)
    assert N.count(N.build(df.where("false"), ["k"], "v"), ["k"]).count() == 0


def test_what_is_shuffled(spark):
    """One row for each group and task, before and after the exchange."""
    df = spark.range(0, 20_000, 1, 4).selectExpr("id % 3 as k", "id + 1 as v")
    plan = N.count(N.build(df, ["k"], "v"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
    assert {r.k: r.n for r in N.count(N.build(df, ["k"], "v"), ["k"]).collect()} == {0: 6667, 1: 6667, 2: 6666}
