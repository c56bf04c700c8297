import random

import numpy as np

from stanzaline.llm import substrings as S
from awkward import awkward_rows, prose


def brute(rows):
    out = []
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    least = {}
    order = lambda i: (1 << 63) - 1 if i is None else i
    for i, w in words:
        for k in range(len(w) - S.WINDOW + 1):
            key = tuple(w[k : k + S.WINDOW])
            least[key] = min(least.get(key, order(i)), order(i))
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - S.WINDOW + 1):
            if least[tuple(w[k : k + S.WINDOW])] < order(i):
                gone[k : k + S.WINDOW] = [True] * S.WINDOW
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in S.dedup_substrings(df).collect()), key=repr)


def test_cover_is_a_difference_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_hash_is_free_of_place():
    a = S.word_hashes(b"x y z " + b"the long road " * 30)
    b = S.word_hashes(b"the long road " * 30)
    assert (S.windows(a, np.array([3]), 60)[0] == S.windows(b, np.array([0]), 60)[0]).all()
    assert (a[3:] == b).all() and len(S.word_hashes(b" \t")) == 0


def test_awkward(docs, clashing, no_docs):
    wanted = brute(awkward_rows())
    assert found(docs) == wanted and found(clashing) == wanted
    assert sum(r[2] for r in wanted) > 0
    assert S.dedup_substrings(no_docs).count() == 0


def test_passages(spark):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (49, 50, 51, 80, 130)]
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(40))
        for _ in range(rng.randrange(3)):
            text += " " + rng.choice(passages) + " " + prose(rng, rng.randrange(30))
        rows.append((i * 7 % 60, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute(rows)


def test_passages_of_many_documents(spark, monkeypatch):
    """Hashes that many documents of a chunk have are answered there; the others meet the least and the greatest of them."""
    rng = random.Random(10)
    passage, other = prose(rng, 70), prose(rng, 60)
    rows = [(i * 11 % 83, f"{prose(rng, rng.randrange(9))} {passage} {prose(rng, rng.randrange(30))}") for i in range(80)]
    rows += [(i, f"{other} {prose(rng, 5)} {passage}") for i in (81, 81, 82, None, None)] + [(90, passage + " x"), (90, passage)]
    for often in (2, 8, 10**9):
        monkeypatch.setattr(S, "OFTEN", often)
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    alone = [(7, f"{k} {passage}") for k in range(20)]
    monkeypatch.setattr(S, "OFTEN", 8)
    assert all(r[2] == 0 for r in found(spark.createDataFrame(alone, "doc_id long, text string")))
    again = [(k, f"{k} " + " ".join([passage] * (20 * (k == 3)))) for k in range(6)]  # often, but in one document
    assert found(spark.createDataFrame(again, "doc_id long, text string")) == brute(again)


def test_chunks_settle_what_they_know():
    """Within one chunk: the answers and questions of a hash by brute force."""
    rng = np.random.default_rng(4)
    for smaller in (False, True):
        chunk = S.Chunks(4, 8, smaller)
        for _ in range(60):
            n = int(rng.integers(1, 60))
            hashes = np.sort(rng.integers(0, 4, n).astype(np.uint64))
            checks, ids = rng.integers(0, 2, n).astype(np.uint32), rng.integers(0, 5, n)
            asks, known = chunk._settle(hashes, checks, ids)
            known = set() if known is None else set(known.tolist())
            groups = {}
            for k in range(n):
                groups.setdefault((hashes[k], checks[k]), []).append(k)
            for own in groups.values():
                low, high = min(ids[own]), max(ids[own])
                here, sent = known & set(own), set(asks.tolist()) & set(own)
                assert all(ids[k] > low if smaller else low != high for k in here)
                assert here | sent == set(own) and {low, high} <= set(ids[list(sent)]) or smaller and low in ids[list(sent)]
