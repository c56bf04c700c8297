import random
import zlib

import numpy as np
import pytest

from awkward import awkward_rows, prose
from stanzaline.llm import toxicity as T

BAD = ["blorgling", "snarfpit", "gruntmok", "vexl"]


def texts(n, seed=1):
    """(text, label): toxic texts hold insults, some as stems with endings; others may hold one in a harmless phrase."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 200)).split()
        y = int(i % 4 == 0)
        for _ in range(max(3, len(words) // 15) if y else 0):
            w = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), w + rng.choice(["a", "en", "os"]) if w == "vexl" else w)
        if not y and i % 3 == 0:
            words[3:3] = ["garden", "snarfpit"]
        out.append((" ".join(words), y))
    return out


def known_of(folded):
    rows = {}
    for t, y in folded:
        for term, n in T.candidates_of(t).items():
            r = rows.setdefault(term, [0] * 5)
            r[0] += y
            r[1 if y else 3] += n
            r[2 if y else 4] += n * n
    return {k: T.Seen(*v) for k, v in rows.items()}


@pytest.fixture(scope="module")
def lexicon():
    folded = [(T.fold(t), y) for t, y in texts(400)]
    return T.fit(known_of(folded), folded)


def slow_matches(folded, lexicon):
    """Every term and phrase by itself at every place."""
    free = lambda at: not (0 <= at < len(folded)) or not folded[at].isalnum()
    spans = [(k, k + len(p)) for p in lexicon.exceptions for k in range(len(folded)) if folded.startswith(p, k) and free(k - 1) and free(k + len(p))]
    out = {}
    for term, w in lexicon.terms.items():
        bare = term.rstrip(" ")
        for k in range(len(folded)):
            if folded.startswith(bare, k) and free(k - 1) and (term == bare or free(k + len(bare))) and not any(s <= k < e for s, e in spans):
                out[k] = max(w, out.get(k, -9e9))
    return sorted(out.items())


def slow_score(lexicon, text):
    folded = T.fold(text or "")
    weight = sum(w for _, w in slow_matches(folded, lexicon))
    words = max(1, len(T._WORD.findall(folded)))
    x = [np.log1p(100 * weight / words), np.log1p(100 * weight / (words + T.SHORT))] if weight else [0, 0]
    return 1 / (1 + np.exp(-(lexicon.offset + lexicon.slopes[0] * x[0] + lexicon.slopes[1] * x[1])))


def test_fold():
    for a, b in (("IDIOT", "1d10t"), ("idiot", "іdіоt"), ("stupid", "$tup1d"), ("loser", "10ser"), ("trash", "tr@sh"), ("scum", "s​cum"), ("moron", "mörön"), ("clown", "сlоwn"), ("trash", "ｔｒａｓｈ")):
        assert T.fold(a) == T.fold(b), (a, b)
    assert T.fold("idiot! you|") == "idiot! you|"
    assert T.fold("stupid$$$ on***") == "stupid$$$ on***"


def test_disguises_score_alike(lexicon):
    plain = texts(1)[0][0]
    for clear, hidden in (("blorgling", "bl0rg1ing"), ("snarfpit", "ѕnаrfріt"), ("gruntmok", "GRÜNTMÖK")):
        plain, masked = plain.replace(clear, clear), plain.replace(clear, hidden)
        assert T.score(lexicon, masked, lexicon.automaton()) == pytest.approx(T.score(lexicon, plain, lexicon.automaton()))


def test_lexicon(lexicon):
    stems = {t.rstrip(" ") for t in lexicon.terms}
    for w in BAD:
        assert any(T.fold(w).startswith(s) for s in stems), (w, stems)
    assert "garden snarfpit" in lexicon.exceptions or T.fold("garden snarfpit") in lexicon.exceptions
    clean = "a stone in the " + "garden snarfpit and winter " * 5
    assert T.score(lexicon, clean, lexicon.automaton()) < 0.5 < T.score(lexicon, "you blorgling of a gruntmok", lexicon.automaton())


def test_length_counts(lexicon):
    rng = random.Random(2)
    short = "blorgling gruntmok " + prose(rng, 30)
    long = "blorgling gruntmok " + prose(rng, 3000)
    assert T.score(lexicon, short, lexicon.automaton()) > T.score(lexicon, long, lexicon.automaton())


def test_held_out_accuracy(lexicon):
    new = texts(300, seed=77)
    right = [(T.score(lexicon, t, lexicon.automaton()) >= T.THRESHOLD) == bool(y) for t, y in new]
    assert np.mean(right) > 0.97


def test_matches_by_definition(lexicon):
    rng = random.Random(8)
    automaton = lexicon.automaton()
    parts = BAD + ["garden snarfpit", "vexlaos", "xvexl", "blorglings", "blorgling-", "stone", "garden", ", "]
    for _ in range(300):
        folded = T.fold("".join(rng.choice(parts) + rng.choice([" ", "", "."]) for _ in range(rng.randrange(12))))
        assert T.matches(folded, automaton) == slow_matches(folded, lexicon)
    assert T.matches("", automaton) == [] and T.Lexicon({}).automaton() is None


def test_frames(docs, clashing, no_docs, lexicon):
    for df in (docs, clashing):
        got = T.score_documents(df, lexicon, "score")
        assert got.columns == [*df.columns, "_score" if "score" in df.columns else "score"]
        rows = got.collect()
        assert len(rows) == len(awkward_rows())
        for r in rows:
            assert r[-1] == pytest.approx(slow_score(lexicon, r.text))
    assert T.score_documents(no_docs, lexicon).count() == 0


def test_training_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(3, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    seen = []
    original, T.fit = T.fit, lambda known, texts: seen.append((known, texts)) or T.Lexicon({})
    try:
        T.train(docs, labels)
        T.train(docs, labels, max_bytes=1500)
        assert T.train(docs, labels.where("doc_id > 99")) == T.Lexicon({})
        T.train(no_docs, labels)
    finally:
        T.fit = original
    allowed = {T.fold(t or "") for i, t, *_ in awkward_rows() if i is not None and i < 12 and i != 3 and zlib.crc32(str(i).encode()) % 5}
    known, texts = seen[0]
    assert texts and {t for t, _ in texts} <= allowed and len({t for t, _ in texts}) == len(texts)
    assert 0 < sum(len(t) for t, _ in seen[1][1]) <= 1500 and seen[2] == ({}, [])
    assert {k: v for k, v in known_of(texts).items() if v.texts >= T.SUPPORT} == known
    assert T.score(T.fit({}, []), "anything", None) == 0.5
    got = docs.where("doc_id is not null").select("doc_id", T.is_held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_query(spark, tmp_path, monkeypatch):
    from stanzaline.llm import queries

    made = texts(400, seed=3)
    rows = [(i, t, "en", "s", 1) for i, (t, _) in enumerate(made)] + [(1000 + k, t, *rest) for k, (_, t, *rest) in enumerate(awkward_rows())] + [(None, "blorgling", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(made)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fit, learned = T.fit, []
    monkeypatch.setattr(T, "fit", lambda *a: learned.append((a[1], fit(*a))) or learned[-1][1])
    got = queries.op13_toxicity(spark, str(tmp_path)).collect()
    (seen, lexicon), by_id = learned[0], {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    held = {i for i in range(len(made)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {t for t, _ in seen} == {T.fold(t) for i, (t, _) in enumerate(made) if i not in held}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.score == pytest.approx(slow_score(lexicon, by_id[r.doc_id])) and r.predicted == int(r.score >= 0.5)
    own = [(r.predicted, made[r.doc_id][1]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([a == b for a, b in own]) > 0.95
