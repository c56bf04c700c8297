import numpy as np

from stanzaline.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    units = [E._usable(v) for _, v, _ in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= E.SIMILAR:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, links[k], least.get(find(k), i)) for k, (i, _, _) in enumerate(rows)), key=repr)


def found(df):
    got = E.near_vectors(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)


def test_decoder_gives_the_nearest_point():
    x = np.random.default_rng(1).standard_normal((500, 8)) * 3
    near = E.decode_e8(x)
    assert len(E._ROOTS) == 240
    gap = ((x - near) ** 2).sum(1)
    others = ((x[:, None] - near[:, None] - E._ROOTS) ** 2).sum(2).min(1)
    assert (gap <= others + 1e-9).all() and (gap <= 1 + 1e-9).all()
    twice = np.rint(2 * near)
    assert (np.abs(2 * near - twice) < 1e-9).all() and (twice.sum(1) % 4 == 0).all()


def test_awkward(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16)).tolist()
    near = (np.array(base[0]) * 2 + 0.05).tolist()
    rows = [(i, v, 0) for i, v in enumerate(base)]
    rows += [(7, near, 1), (8, base[1], 1), (9, base[1], None), (9, base[1], None), (10, None, 0), (11, [0.0] * 16, 0), (12, [1.0, None] + [0.0] * 14, 0), (13, [float("nan")] * 16, 0), (14, [float("inf")] * 16, 0), (15, [], 0), (16, [1.0], 0), (17, [2.0], 0), (None, base[2], 0), (None, None, None), (18, [-0.0, 1.0] + [0.0] * 14, 0), (19, [0.0, 1.0] + [0.0] * 14, 0)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = brute(rows)
    assert found(df) == wanted
    assert found(df.select("*", *(F.lit(1).alias(c) for c in ("node", "cell", "cells", "weight", "vector", "links", "component")))) == wanted
    assert E.near_vectors(df.where("false")).count() == 0


def test_recall_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(1 + c % 12):
            rows.append((len(rows), (centre + rng.standard_normal(32) * 0.035).tolist(), c))
    wanted, got = brute(rows), found(spark.createDataFrame(rows, SCHEMA))
    links = sum(w[1] for w in wanted)
    assert sum(g[1] for g in got) >= 0.97 * links and all(g[1] <= w[1] for g, w in zip(got, wanted))
    monkeypatch.setattr(E, "BLOCK", 3)
    assert found(spark.createDataFrame(rows, SCHEMA)) == got


def test_recall_at_the_threshold():
    """Pairs just above the threshold share a cell, whatever the number of dimensions."""
    rng = np.random.default_rng(5)
    for dim in (16, 64, 256):
        a = rng.standard_normal((2000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side = rng.standard_normal((2000, dim))
        side -= (side * a).sum(1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        b = 0.951 * a + np.sqrt(1 - 0.951**2) * side
        x, y = (E.cells(v).reshape(len(v), -1) for v in (a, b))
        met = [bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist())]
        assert np.mean(met) >= 0.99, dim


def test_sizes_do_not_matter(spark):
    """Components far from one link as if they were scaled; subnormal ones too."""
    base = [0.3, -0.2, 0.9, 0.1] * 4
    near = [x + 0.01 for x in base]
    rows = [(k, [x * f for x in v]) for k, (v, f) in enumerate([(base, 1.0), (near, 1e200), (base, 1e-200), (near, 1e-310), ([0.0] * 16, 1.0)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df) == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0), (4, 0, 4)]
