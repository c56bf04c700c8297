import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from awkward import awkward_rows, prose
from stanzaline.llm import phrases as P


def brute(rows, top=P.TOP):
    """The contract by plain counting: (lang, rank, phrase, a, l, r, n, score)."""
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        found, often = [], {g: n for g, n in f.items() if len(g) > 1 and n >= P.MIN_COUNT}
        for g, a in often.items():
            cuts = [(Fraction(1_000_000 * a * a, f[g[:k]] * f[g[k:]]).__floor__(), k) for k in range(1, len(g))]
            score, k = min(cuts)
            inside = any(len(h) > len(g) and any(h[s : s + len(g)] == g for s in range(len(h))) and 100 * n >= 50 * a for h, n in often.items())
            if not inside:
                found.append((-score, -a, " ".join(g).encode(), " ".join(g), f[g[:k]], f[g[k:]]))
        out += [(lang, rank, g, -a, left, right, total[lang], -score) for rank, (score, a, _, g, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in P.collocations(df, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [w for w in "the of and river stone light a a b Ünder lONG |".split()]
    few = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r", "! "]) for _ in range(rng.randrange(110))), rng.choice(["en", "de", None, "und"]), "s", 1) for i in range(200)]
    return few + awkward_rows() + [(900, "same words again " * 400, "xx", None, None), (901, "x", "yy", None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_against_counting(spark, rows):
    wanted = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df) == wanted and len(wanted) > 40
    assert {r[0] for r in wanted} >= {"en", "de", "und", "xx"}
    assert found(df, top=3) == [r for r in brute(rows, 3)]


def test_hot_pivots(spark, rows, monkeypatch):
    """All pivots hot: n-grams are routed by themselves."""
    monkeypatch.setattr(P, "HOT_LEAST", 0)
    monkeypatch.setattr(P, "HOT_SHARE", 10**9)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_frames(clashing, docs, no_docs):
    assert found(clashing) == found(docs) == brute(awkward_rows())
    assert found(no_docs) == []


def test_large_counts(spark):
    """Products that pass 64 bits stay exact."""
    counts = spark.createDataFrame([(3_000_000_011, 3_000_000_019, 3_000_000_021)], "a long, l long, r long")
    wide = [counts[c].cast("decimal(19,0)") for c in "alr"]
    got = counts.select(P._quotient(wide[0] * wide[0] * 1_000_000, wide[1] * wide[2]).alias("q")).first().q
    assert got == 3_000_000_011**2 * 1_000_000 // (3_000_000_019 * 3_000_000_021)


def test_parts_end_at_punctuation():
    rng = random.Random(1)
    for size in (1, 7, 40, 10_000):
        text = "".join(rng.choice("ab ,.") for _ in range(500)).encode() + b"word " * 30
        parts = list(P._parts(text, size))
        assert b"".join(parts) == text
        ends = np.cumsum([len(p) for p in parts])
        assert all(e in (0, len(text)) or text[e - 1 : e] in b",." for e in ends) and (size > 500 or len(parts) > 3)


def test_every_occurrence_has_one_owner():
    """Fragments of all rarities give each n-gram its count, whatever the order of the words."""
    rng = random.Random(9)
    text = " ".join(rng.choice("abcde") for _ in range(300)) + ". a b"
    wanted = Counter()
    for piece in text.split("."):
        line = piece.split()
        wanted.update(" ".join(line[k : k + s]) for s in (2, 3) for k in range(len(line) - s + 1))
    for seed in range(4):
        levels = np.random.default_rng(seed).integers(1, 9, P.PAGES * P.PAGE).astype(np.uint8)
        for hot in (0, 5, 99):
            got = Counter()
            for batch in P._fragments("en", text.encode(), levels, hot):
                for key, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    got.update({key: int(body)} if " " in key else P.mine([body], key))
            assert {g: n for g, n in got.items() if n >= P.MIN_COUNT} == {g: n for g, n in wanted.items() if n >= P.MIN_COUNT}


def test_words_that_cannot_be_frequent_are_blanks():
    text = b"a b " * 20 + b"rare word"
    batches = list(P._fragments("en", text, np.zeros(P.PAGES * P.PAGE, np.uint8), 9))
    assert batches == []
    assert P.level(np.array([0, 9, 10, 20, 1 << 62])).tolist() == [0, 0, 1, 7, 255]


def test_query(spark, tmp_path, rows):
    from stanzaline.llm import queries

    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_phrases(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for c, t in got.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_long_text(spark):
    text = prose(random.Random(2), 20_000)
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
