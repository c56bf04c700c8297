import random
from collections import Counter

import numpy as np
import pytest

from awkward import awkward_rows, prose
from stanzaline.llm import neardup as N


def bag(text):
    w = (text or "").encode().split()
    n = min(N.WORDS, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def group_list(rows):
    """The least doc_id of each row's group, by comparing every pair."""
    bags = [bag(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= N.SIMILAR:
                root[find(i)] = find(j)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k), i) if bags[k] else i for k, (i, *_) in enumerate(rows)]


def groups(rows):
    return sorted(zip((r[0] for r in rows), group_list(rows)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.group_id) for r in N.near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize("high", [1, 6])
def test_signatures_estimate_weighted_jaccard(high):
    rng = np.random.default_rng(high)
    errors = []
    for _ in range(40):
        a = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        wa = rng.integers(1, high + 1, len(a))
        keep = rng.random(len(a)) < rng.uniform(0.4, 1)
        b, wb = a[keep], np.maximum(1, wa[keep] + rng.integers(-1, 2, keep.sum()) * (high > 1))
        s = N.signatures([(a, wa), (b, wb)])
        errors.append((s[0] == s[1]).mean() - N.overlap((a, wa), (b, wb)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signatures_of_any_batch():
    texts = [t.encode() for _, t, *_ in awkward_rows() if t]
    bags = [N.shingles(t) for t in texts]
    together = N.signatures(bags)
    for k, b in enumerate(bags):
        assert (N.signatures([b])[0] == together[k]).all()


def test_awkward(docs, clashing, no_docs):
    wanted = groups(awkward_rows())
    assert found(docs) == wanted and found(clashing) == wanted
    assert N.near_duplicates(no_docs).count() == 0


def test_groups(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = prose(rng, rng.randrange(8, 150)).split()
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(["x", "y"])
            rows.append((len(rows) * 5 % 97, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == groups(rows)


def test_blocks_link_what_the_least_misses(spark):
    """Documents that are near each other but not near the least of their bucket are found in blocks."""
    import pyarrow as pa

    rng = random.Random(2)
    a, b = prose(rng, 100).encode(), prose(rng, 100).encode()
    near = b.split()
    near[50] = b"z"
    table = pa.table({"node": [2, 1, 2, 3], "component": [2, 1, 2, 3], "text": [b, a, b, b" ".join(near)], "outside": [True, False, False, False]})
    assert N._check_block(table).to_pylist() == [{"a": 2, "b": 3}]
    assert N._check_block(table.set_column(1, "component", pa.array([2, 1, 2, 2]))).to_pylist() == []


def test_across_components(spark, monkeypatch):
    """Buckets that hold several components: every link between two of them is found, in blocks of any size."""
    rng = random.Random(12)
    texts = []
    for _ in range(9):
        base = prose(rng, 100).split()
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            own[rng.randrange(100)] = "x"
            texts.append(" ".join(own).encode())
    rows = [(k, bag(t.decode())) for k, t in enumerate(texts)]
    near = {(i, j) for i, a in rows for j, b in rows if i < j and jaccard(a, b) >= N.SIMILAR}
    given = {(0, 1)}  # one component from the start
    for block, each in ((128, 1000), (3, 4)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N.common, "KEY_ROWS", each)
        keyed = spark.createDataFrame([(k, 7) for k in range(len(texts))] + [(k, 8) for k in range(3)], "node long, band long")
        shared = spark.createDataFrame([(7, 0, len(texts), 1), (8, 0, 3, 2)], "band long, least long, n long, members long")
        part = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
        frame = spark.createDataFrame(list(enumerate(texts)), "node long, text binary")
        got = {tuple(sorted(r)) for r in N._compare_across(keyed, shared, part, frame).collect()}
        assert got <= near and joined(len(texts), got | given) == joined(len(texts), near | given)


def joined(n, links):
    """The least number that each of n is linked with."""
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_one_of_each_group_is_kept(spark):
    """Near copies that tie on doc_id, or have none, are told apart by their texts."""
    rng = random.Random(14)
    base = prose(rng, 200).split()
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in (10, 30, 50)]
    for ids in ((5, 5, 5), (None, None, None), (None, 2, 2)):
        df = spark.createDataFrame(list(zip(ids, near)) + [(ids[0], near[0])], "doc_id long, text string")
        got = N.near_duplicates(df).collect()
        assert len(got) == 4 and len({r.row for r in got if r.kept}) == 1
        assert {r.group_id for r in got} == {min((i for i in ids if i is not None), default=None)}


def test_components(spark):
    rng = random.Random(3)
    from stanzaline.llm.components import components

    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
