import random
import zlib

import numpy as np
import pytest

from awkward import awkward_rows, prose
from stanzaline.llm import quality as Q


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(4)
    good = [prose(rng, rng.randrange(5, 120)) for _ in range(60)]
    bad = [" ".join(w + "$$$" for w in prose(rng, rng.randrange(5, 120)).split()) for _ in range(30)]
    return good, bad


@pytest.fixture(scope="module")
def model(sample):
    good, bad = sample
    return Q.fit([t.encode() for t in good[:40] + bad[:20]], [1] * 40 + [0] * 20, steps=150)


def test_held_out_accuracy(model, sample):
    good, bad = sample
    right = [Q.score(model, t.encode()) >= Q.THRESHOLD for t in good[40:]] + [Q.score(model, t.encode()) < Q.THRESHOLD for t in bad[20:]]
    assert np.mean(right) >= 0.9


def test_chunks_cover():
    for n in (0, 1, Q.OVERLAP, Q.CHUNK, Q.CHUNK + 1, 5000):
        data = bytes(1 + k % 255 for k in range(n))
        rows = Q.chunks(data)
        back = bytes(rows[0]) + b"".join(bytes(r[Q.OVERLAP :]) for r in rows[1:])
        assert back.rstrip(b"\0") == data


def test_gradients_where_no_filter_answers():
    """A text that leaves every filter at nothing, and one of which a slice of chunks does."""
    model = Q.fit([b"a", b"b"], [0, 1], steps=1)
    zeros = lambda: {n: np.zeros_like(np.asarray(getattr(model, n), np.float32)) for n in ("embed", "filters", "bias", "dense", "offset")}
    model.bias = np.full(Q.FILTERS, -1e6, np.float32)
    into = zeros()
    Q._gradients(model, b"words", 1, into)
    assert into["offset"] and not any(into[n].any() for n in ("embed", "filters", "bias", "dense"))
    # one byte answers, in the first slice alone
    model.embed[:] = 0
    model.embed[ord("x")] = 1
    model.filters[:], model.bias[:] = 1, -1
    model.dense[:Q.FILTERS], model.dense[Q.FILTERS :] = 0, 1
    into = zeros()
    Q._gradients(model, b"x" * 100 + b"y" * (Q.CHUNK * (Q._AT_ONCE + 3)), 0, into)
    assert into["filters"].any() and into["embed"][ord("x")].any() and not into["embed"][ord("y")].any()


def test_gradients_by_differences(sample):
    model = Q.fit([b"a", b"b"], [0, 1], steps=1)
    for n in ("embed", "filters", "bias", "dense"):
        setattr(model, n, getattr(model, n).astype(np.float64))
    text, label = sample[0][0].encode() * 3, 1
    names = ("embed", "filters", "bias", "dense", "offset")
    into = {n: np.zeros_like(np.asarray(getattr(model, n), np.float64)) for n in names}
    Q._gradients(model, text, label, into)
    loss = lambda: -np.log(Q.score(model, text))
    rng = np.random.default_rng(0)
    for n in ("filters", "bias", "dense"):
        part = getattr(model, n)
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in part.shape)
            kept, step = part[at], 1e-5
            part[at] = kept + step
            up = loss()
            part[at] = kept - step
            down = loss()
            part[at] = kept
            assert abs((up - down) / (2 * step) - into[n][at]) < 1e-3


def test_long_texts_in_parts(model, monkeypatch):
    text = (prose(random.Random(1), 5000)).encode()
    whole = Q.score(model, text)
    monkeypatch.setattr(Q, "_AT_ONCE", 3)
    assert abs(Q.score(model, text) - whole) < 1e-6


def test_frames(docs, clashing, no_docs, model):
    for df in (docs, clashing):
        got = Q.score_documents(df, model, "quality_of_text")
        assert got.columns == [*df.columns, "quality_of_text"]
        rows = got.collect()
        assert len(rows) == len(awkward_rows()) and all(0 <= r.quality_of_text <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.quality_of_text) == r.quality_of_text
    assert Q.score_documents(no_docs, model).count() == 0


def test_training_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, 0, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    seen = {}

    def keep(texts, ys):
        seen.update(zip(texts, ys))
        return Q.Model(None, None, None, None, 0.0, constant=0.5)

    original, Q.fit = Q.fit, keep
    try:
        Q.train(docs, labels)
    finally:
        Q.fit = original
    texts = {t: i for i, t, *_ in awkward_rows() if t}
    held = {i for i in range(12) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert seen and not {texts[t.decode()] for t in seen if t} & (held | {3})
    none = Q.train(docs, labels.where("doc_id > 99"))
    assert none.constant == 0.5
    got = docs.where("doc_id is not null").select("doc_id", Q.is_held_out("doc_id").alias("h")).collect()
    assert all(r.h == Q.held_out(r.doc_id) for r in got)


def slow_score(model, data):
    """The network by its definition: every window of every chunk by itself."""
    step, count = Q.CHUNK - Q.OVERLAP, max(1, -(-(len(data) - Q.OVERLAP) // (Q.CHUNK - Q.OVERLAP)))
    pooled = []
    for c in range(count):
        chunk = data[c * step : c * step + Q.CHUNK].ljust(Q.CHUNK, b"\0")
        best = [-np.inf] * Q.FILTERS
        for at in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE):
            window = np.concatenate([model.embed[b] for b in chunk[at : at + Q.WIDTH]])
            best = np.maximum(best, window @ model.filters)
        pooled.append(np.maximum(best + model.bias, 0))
    features = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)])
    return 1 / (1 + np.exp(-(features @ model.dense + model.offset)))


def test_score_by_definition(model, sample):
    assert len(model.dense) == 2 * Q.FILTERS  # nothing but pooled filters goes in
    for text in ("", "a", sample[0][0], sample[1][3] * 4, "é" * 3000):
        assert abs(Q.score(model, text.encode()) - slow_score(model, text.encode())) < 1e-5


def test_gradients_in_slices(model, sample, monkeypatch):
    text = (sample[0][0] * 30).encode()
    names = ("embed", "filters", "bias", "dense", "offset")
    whole, parts = ({n: np.zeros_like(np.asarray(getattr(model, n), np.float64)) for n in names} for _ in range(2))
    Q._gradients(model, text, 0, whole)
    monkeypatch.setattr(Q, "_AT_ONCE", 2)
    Q._gradients(model, text, 0, parts)
    assert len(Q.chunks(text)) > 4 and all(np.allclose(whole[n], parts[n], atol=1e-5) for n in names)


def test_sample_is_bounded(spark, monkeypatch):
    """The fit gets no more bytes than it may, and one text of a doc_id that has several."""
    docs = spark.createDataFrame([(i, "x" * 10 * (i + 1)) for i in range(20)] + [(3, "a")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda texts, ys: seen.append(texts) or Q.Model(None, None, None, None, 0.0, constant=0.5))
    Q.train(docs, labels)
    Q.train(docs, labels, max_bytes=300)
    held = sum(Q.held_out(i) for i in range(20))
    assert len(seen[0]) == 20 - held and (b"a" in seen[0]) == (not Q.held_out(3))
    assert 0 < len(seen[1]) < len(seen[0]) and sum(map(len, seen[1])) <= 300


def test_query(spark, tmp_path, sample, monkeypatch):
    """The registered query: remainders, thresholds, and scores of the model that it learned, made again by its definition."""
    from stanzaline.llm import queries

    good, bad = sample
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(good + bad)] + [(500 + k, t, *rest) for k, (_, t, *rest) in enumerate(awkward_rows()) if len(t or "") < 3000] + [(None, "x", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good + bad))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fit, learned = Q.fit, []

    def short(texts, ys):
        learned.append((set(texts), fit(texts, ys, steps=150)))
        return learned[-1][1]

    monkeypatch.setattr(Q, "fit", short)
    got = queries.op5_quality(spark, str(tmp_path)).collect()
    texts, model = learned[0]
    assert len(got) == len(rows)
    left = sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.predicted, round(r.score, 4)) for r in got))
    wanted = []
    for i, t, *_ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        p = slow_score(model, (t or "").encode())
        wanted.append((i is None, i or 0, held, int(p >= 0.7), round(float(p), 4)))
        if held and i < 500:
            assert t.encode() not in texts
    assert [x[:4] for x in left] == [x[:4] for x in sorted(wanted)] and all(abs(a[4] - b[4]) < 2e-4 for a, b in zip(left, sorted(wanted)))
    own = [(r.predicted, int(r.doc_id < len(good))) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(a == b for a, b in own) >= 0.85 * len(own)
