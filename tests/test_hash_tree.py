"""Trees of hashes against multisets of Python."""

import os
import random
import shutil
from collections import Counter, defaultdict

import pytest

from stanzaline.operators import hash_tree as H

SCHEMA = "k string, j int, v double, w string"


def made(rng, n):
    return [(rng.choice([None, "a", "b", "c", ""]), rng.choice([None, *range(40)]), rng.choice([None, 0.0, 1.5, -2.0]), rng.choice([None, "x", "y"])) for _ in range(n)]


def kinds(a, b):
    sides = defaultdict(lambda: (Counter(), Counter()))
    for at, rows in enumerate((a, b)):
        for r in rows:
            sides[r[:2]][at][r[2:]] += 1
    return sorted(((*k, "only left" if not y else "only right" if not x else "differs") for k, (x, y) in sides.items() if x != y), key=repr)


def test_differences(spark):
    rng = random.Random(3)
    for n in (0, 1, 300):
        a = made(rng, n)
        b = [r for r in a if rng.random() > 0.05] + made(rng, n // 50)
        fa, fb = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (a, b))
        got = sorted(map(tuple, H.differences(fa, fb, ["k", "j"], ["v", "w"]).collect()), key=repr)
        assert got == kinds(a, b)
        assert {tuple(r) for r in H.left_only(fa, fb).collect()} == set(a) - set(b)
    twice = spark.createDataFrame([*a, a[0]], SCHEMA)
    assert [r.kind for r in H.differences(twice, fa, ["k", "j"], ["v", "w"]).collect()] == ["differs"]  # a row repeated
    signs = spark.createDataFrame([("a", 1, -0.0, "x"), ("b", 2, float("nan"), None)], SCHEMA)
    same = spark.createDataFrame([("b", 2, float("nan"), None), ("a", 1, 0.0, "x")], SCHEMA)
    assert H.differences(signs, same, ["k", "j"], ["v", "w"]).count() == 0


def test_nulls_do_not_move(spark):
    one = spark.createDataFrame([("k", 1, None, "x")], SCHEMA)
    other = spark.createDataFrame([("k", 1, None, None)], SCHEMA)
    assert H.differences(one, other, ["k", "j"], ["v", "w"]).count() == 1
    assert {tuple(r) for r in H.left_only(one.select("w", "k"), one.select("k", "w")).collect()} == {("x", "k")}


def test_tree_adds_up(spark):
    df = spark.createDataFrame(made(random.Random(8), 500), SCHEMA)
    nodes = H.tree(H.leaves(df, ["k", "j"], df.columns)).collect()
    for level in range(H.DEPTH + 1):
        assert sum(r.n for r in nodes if r.level == level) == 500
    leaf = {r.node: r for r in nodes if r.level == H.DEPTH}
    for r in (r for r in nodes if r.level == H.DEPTH - 1):
        assert r.h0 == sum(x.h0 for n, x in leaf.items() if n // H.FAN == r.node)


def test_only_differing_folders_are_read(spark, tmp_path):
    """Everything else can be taken off the disk before the comparison."""
    a = spark.range(20_000).selectExpr("id as k", "id % 7 as v")
    b = a.selectExpr("k", "if(k in (11, 12345), -1, v) as v").where("k != 77").repartition(5)
    stored = []
    for name, df in (("a", a), ("b", b), ("c", a.repartition(3))):
        H.store(df, ["k"], f"{tmp_path}/{name}")
        stored.append(H.Stored(spark, f"{tmp_path}/{name}", "k bigint, v bigint"))
    found = H.descend(stored[0].tree(), stored[1].tree())
    assert len(found) == 3 and H.descend(stored[0].tree(), stored[2].tree()) == []
    needed = {f"_node={n // H.FAN ** (H.DEPTH - H.FOLDERS)}" for n in found}
    for name in "abc":
        for folder in os.listdir(f"{tmp_path}/{name}/rows"):
            if folder.startswith("_node=") and (name == "c" or folder not in needed):
                shutil.rmtree(f"{tmp_path}/{name}/rows/{folder}")
    got = {tuple(r) for r in H.stored_differences(*stored[:2], ["k"], ["v"]).collect()}
    assert got == {(11, "differs"), (12345, "differs"), (77, "only left")}
    assert H.stored_differences(stored[0], stored[2], ["k"], ["v"]).count() == 0


@pytest.mark.parametrize("rows", [0, 5])
def test_stored_tables_without_rows(spark, tmp_path, rows):
    for name, n in (("a", rows), ("b", 0)):
        H.store(spark.range(n).selectExpr("id as k", "id as v"), ["k"], f"{tmp_path}/{name}", folders=1)
    a, b = (H.Stored(spark, f"{tmp_path}/{n}", "k bigint, v bigint", folders=1) for n in "ab")
    assert H.stored_differences(a, b, ["k"], ["v"]).count() == rows
