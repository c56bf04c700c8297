import random

from pyspark.sql import functions as F

from stanzaline.operators import audit as A
from stanzaline.operators import joins as J
from stanzaline.operators import lifecycle as L


def rows(df, *by):
    return sorted(tuple(r) for r in df.select(*(by or df.columns)).collect())


def test_copy(spark):
    spark.createDataFrame([(1, "a")], "id long, t string").write.saveAsTable("to_copy")
    copy = L.copy_table(spark, "to_copy", "copied", {"t": "text"})
    assert copy.columns == ["id", "text"] and rows(copy) == [(1, "a")]


def test_patch_and_upsert(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, t string, n int")
    fixed = L.patch(df, spark.createDataFrame([(2, None, 9), (3, "x", 0)], "id long, t string, n int"), "id")
    assert rows(fixed) == [(1, "a", 1), (2, "b", 9)]
    assert rows(L.changed(df, fixed, "id", "n")) == [(2,)]
    assert rows(L.unmet(df, spark.createDataFrame([(1, "a"), (2, "z"), (4, "q")], "id long, t string"), "id")) == [(2,), (4,)]
    new = spark.createDataFrame([(2, "z", 0), (3, "y", 2), (3, "x", 1)], "id long, t string, n int")
    assert rows(L.insert_or_ignore(df, new, ["id"], ["n"])) == [(1, "a", 1), (2, "b", 2), (3, "x", 1)]
    assert rows(L.last_wins(new, ["id"], ["n"])) == [(2, "z", 0), (3, "y", 2)]
    assert rows(L.delete(df, df.where("id = 1"), "id")) == [(2, "b", 2)]


def test_audits(spark):
    df = spark.createDataFrame([("Ruth", 0, 1), ("Ruth", 0, 2), ("Ruth", 0, 6), ("Job", 9, 1)], "book string, place int, v int")
    assert rows(A.gaps(df, ["book"], "v")) == [("Ruth", 3, 5)]
    assert rows(A.out_of_order(df, "book", "place", ["Ruth", "Job"])) == [("Job", 9)]
    leaks = A.leaks(spark.createDataFrame([("<b>x",), ("a &amp; {{t}}",), (r"\nd x",), (None,)], "t string"), "t")
    assert rows(leaks) == [("brace", 1), ("entity", 1), ("marker", 1), ("tag", 1)]


def test_notes_cover(spark):
    """Sentinels: verse 0 opens a chapter's start and end; (0, 0, 0, 0) covers nothing."""
    notes = spark.createDataFrame([(1, 0, 1, 0, 1, 0), (2, 0, 1, 3, 2, 2), (3, 0, 0, 0, 0, 0), (4, 0, 2, 2, 2, 0)], "id long, book_order int, sc int, sv int, ec int, ev int")
    keys = spark.createDataFrame([(0, 1, 1), (0, 1, 3), (0, 2, 2), (0, 2, 9)], "book_order int, ch int, v int")
    assert rows(J.covering_notes(keys, notes), "ch", "v", "id") == [(1, 1, 1), (1, 3, 1), (1, 3, 2), (2, 2, 2), (2, 2, 4), (2, 9, 4)]


def test_overlap_tiers(spark):
    anchors = spark.createDataFrame([(1, 1, 5, 6), (2, 1, 9, 9), (3, 1, 20, 30)], "dev_id long, ch long, vs long, ve long")
    keys = spark.createDataFrame([(1, 5), (1, 8), (1, 40)], "ch long, v long")
    assert rows(J.overlap_tiers(keys, anchors), "v", "dev_id", "tier") == [(5, 1, 0), (8, 1, 1), (8, 2, 1)]


def test_dyadic_covers(spark):
    """Each number of an interval lies in one block, no other number in any; long intervals are few rows."""
    rng = random.Random(4)
    pairs = [(a, a + rng.randrange(-3, 40)) for a in (rng.randrange(-30, 60) for _ in range(300))] + [(0, 10**6 - 1), (3, 10**6 + 5), (5, None), (-(10**9), 10**9)]
    found = {}
    for r in J.dyadic_cover(spark.createDataFrame(pairs, "a long, b long").distinct(), F.col("a"), F.col("b")).collect():
        found.setdefault((r.a, r.b), []).append((r._block << r._level, (r._block + 1 << r._level) - 1))
    for low, high in pairs:
        blocks = found.get((low, high), [])
        if high is None or high < low:
            assert not blocks
        elif high - low < 100:
            assert sorted(n for s, e in blocks for n in range(s, e + 1)) == list(range(low, high + 1))
        else:
            assert len(blocks) <= 62 and sum(e - s + 1 for s, e in blocks) == high - low + 1 and (high - low > 10**7 or len(blocks) <= 40)


def test_points_in_long_intervals(spark):
    rng = random.Random(9)
    intervals = [(i, k := rng.randrange(3), a := rng.randrange(1000), a + rng.choice([0, 1, 5, 900, 10**6])) for i in range(60)]
    points = [(rng.randrange(3), rng.randrange(2000)) for _ in range(200)]
    left, right = spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(intervals, "id int, k int, a int, b int")
    met = J.meet_intervals(left, right, ["k"], "at", F.col("a"), F.col("b"))
    assert rows(met, "k", "at", "id") == sorted((k, at, i) for k, at in points for i, own, a, b in intervals if k == own and a <= at <= b)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert J.meet_intervals(left, right.where("false"), ["k"], "at", F.col("a"), F.col("b")).count() == 0
    assert rows(J.meet_intervals(left.limit(1).select(F.lit(7).alias("at")), right.where("id < 9"), [], "at", F.col("a"), F.col("b")), "id") == sorted((i,) for i, _, a, b in intervals if i < 9 and a <= 7 <= b)


def test_no_nested_loops(spark):
    """The interval join has an equality."""
    notes = spark.range(10).select(F.col("id"), (F.col("id") % 3).alias("book_order"), (F.col("id") % 2).cast("int").alias("sc"), F.lit(1).alias("sv"), F.lit(2).alias("ec"), F.lit(0).alias("ev"))
    keys = spark.range(10).select((F.col("id") % 3).alias("book_order"), (F.col("id") % 4).cast("int").alias("ch"), F.col("id").cast("int").alias("v"))
    plan = J.covering_notes(keys, notes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
