"""Many patterns against str.find."""

import random
from collections import Counter

import pytest

from stanzaline.operators import patterns as P


def brute(texts, patterns, inside):
    out = []
    for i, t in texts:
        for p in {p for p in patterns if p}:
            at = (t or "").find(p)
            while at >= 0:
                end = at + len(p)
                if not (inside and (at and t[at - 1] in inside or end < len(t) and t[end] in inside)):
                    out.append((i, p, at, end))
                at = t.find(p, at + 1)
    return out


@pytest.mark.parametrize("inside", ["", "ab"])
@pytest.mark.parametrize("most", [1 << 20, 40])
def test_hits_and_counts(spark, inside, most):
    """One automaton and several; overlaps, patterns within patterns, characters of two UTF-16 units, nulls and repeats."""
    rng = random.Random(9)
    word = lambda top: "".join(rng.choice("ab é😀") for _ in range(rng.randrange(top)))
    patterns = [word(4) for _ in range(40)] + [None, "", "zz", "ab", "ab"]
    texts = [(i, rng.choice([None, "", word(60), word(60)])) for i in range(200)] + [(7, "ab ab"), (7, "ab ab")]
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    given = spark.createDataFrame([(p,) for p in patterns], "p string")
    wanted = brute(texts, patterns, inside)
    got = [tuple(r) for r in P.hits(docs, "id", "text", given, "p", inside, most).collect()]
    assert sorted(got) == sorted(wanted)
    n = Counter(p for _, p, _, _ in wanted)
    texts_with = Counter(p for i, t in texts for p in {p for p in patterns if p} if brute([(i, t)], [p], inside))
    counted = {r.pattern: (r.n_texts, r.n_hits) for r in P.counts(docs, "text", given, "p", inside, most).collect()}
    assert counted == {p: (texts_with[p], n[p]) for p in n}


def test_hits_in_parts_and_none(spark, monkeypatch):
    monkeypatch.setattr(P, "HITS", 10)
    docs = spark.createDataFrame([(1, "a" * 95)], "id int, text string")
    given = spark.createDataFrame([("a",)], "p string")
    assert sorted(r.start for r in P.hits(docs, "id", "text", given, "p").collect()) == list(range(95))
    assert P.hits(docs, "id", "text", given.where("false"), "p").count() == 0
    assert P.counts(docs.where("false"), "text", given, "p").count() == 0


def test_a_hundred_thousand_patterns(spark):
    """As many patterns, one pass: every number below 100,000 as a word."""
    given = spark.range(100_000).selectExpr("cast(id as string) as p")
    docs = spark.range(300).selectExpr("id", "concat_ws(' ', id * 331, id, 'x', id * 331) as text")
    got = P.counts(docs, "text", given, "p", inside="0123456789").collect()
    want = Counter(str(n) for i in range(300) for n in (i * 331, i, i * 331))
    assert {r.pattern: r.n_hits for r in got} == dict(want)
