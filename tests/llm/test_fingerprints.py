import hashlib

import xxhash

from stanzaline.llm import fingerprints as P
from awkward import awkward_rows, prose


def test_difference_is_bounded_and_symmetric():
    import random

    rng = random.Random(1)
    texts = [prose(rng, 200).encode() for _ in range(5)] + [b"", b"a", b"abcd" * 5000]
    for a in texts:
        for b in texts:
            x, y = P.digest(a), P.digest(b)
            assert 0 <= P.difference(x, y) <= P.MAX_SCORE and P.difference(x, y) == P.difference(y, x)
        assert P.likeness(P.digest(a), P.digest(a)) == 1.0
    half = texts[0][: len(texts[0]) // 2] + texts[1][: len(texts[0]) // 2]
    assert P.likeness(P.digest(texts[0]), P.digest(half)) > P.likeness(P.digest(texts[0]), P.digest(b"\x00\xff" * 500))


def test_pieces_do_not_matter(monkeypatch):
    data = bytes(range(256)) * 40
    whole = P.digest(data)
    monkeypatch.setattr(P, "_PIECE", 100)
    assert P.digest(data) == whole


def place(r):
    """The order of rows: doc_id from the top, then the hash of the text as a signed number, then the text."""
    tie = xxhash.xxh64(r[1].encode(), seed=42).intdigest()
    return -r[0], tie - (1 << 64) * (tie >> 63), r[1].encode()


def expected(rows):
    order = sorted((((-(1 << 63) if i is None else i), t or "", i) for i, t, *_ in rows), key=place)
    out = []
    for k, (_, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        out.append((i, len(text), hashlib.sha256(P.edited(text, after).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edits_by_brute_force(docs, clashing):
    for df in (docs, clashing):
        for parts in (1, 3, 7):
            got = P.with_next(df, P.EDITED, P._pair, parts).collect()
            assert sorted(((r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest()) for r in got), key=repr) == expected(awkward_rows())
            assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_single_and_empty(spark, no_docs):
    assert P.fingerprint_edits(no_docs).count() == 0 and P.fingerprint(no_docs).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert P.fingerprint_edits(one).first().edited_text == "abcabc"


def plain_digest(data):
    """The digest by its definition, one triplet at a time."""
    data = data.ljust(5, b"\0") if data else data
    counts = [0] * 128
    for end in range(4, len(data)):
        for (i, j, k), salt in zip(P._TRIPLETS, P._SALTS):
            counts[int(P._TABLES[0][data[end - i]] ^ P._TABLES[1][data[end - j]] ^ P._TABLES[2][data[end - k]] ^ salt)] += 1
    q1, q2, q3 = (sorted(counts)[n] for n in (31, 63, 95))
    return [sum(c > q for q in (q1, q2, q3)) for c in counts]


def test_digest_by_definition():
    import random

    rng = random.Random(6)
    for text in (prose(rng, 60), "é" * 9, "abc", "x" * 500, prose(rng, 3)):
        data = text.encode()
        packed = bytes.fromhex(P.digest(data)[7:])
        assert [packed[k // 4] >> 2 * (k % 4) & 3 for k in range(128)] == plain_digest(data)
    assert set(P.digest(b"")[7:]) == {"0"}


def slow_likeness(a, b):
    if a == b:
        return 1.0
    score = int(a[:2] != b[:2])
    gap = abs(int(a[2:4], 16) - int(b[2:4], 16))
    score += gap if gap < 2 else 12 * gap if gap < 8 else 96 + gap
    x, y = int(a[4:7], 16), int(b[4:7], 16)
    for gap in (abs(x % 32 - y % 32), abs(x // 32 - y // 32)):
        score += gap if gap < 2 else 4 * (gap - 1)
    for p, q in zip(bytes.fromhex(a[7:]), bytes.fromhex(b[7:])):
        for k in range(4):
            gap = abs((p >> 2 * k & 3) - (q >> 2 * k & 3))
            score += 6 if gap == 3 else gap
    return 1 - min(score, 300) / 300


def test_query(spark, tmp_path):
    """The registered query: counts, digests and likenesses made again from the rows alone, and edited texts told from other ones."""
    import random

    from stanzaline.llm import queries

    rng = random.Random(7)
    themes = [[rng.choice("aeiou") + rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("nrst") for _ in range(40)] for _ in range(30)]
    rows = awkward_rows() + [(200 + k, " ".join(rng.choice(t) for _ in range(rng.randrange(60, 300))), "en", "s", 1) for k, t in enumerate(themes)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_fingerprints(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(rows)
    own = {hashlib.sha256((t or "").encode()).hexdigest(): P.digest((t or "").encode()) for _, t, *_ in rows}
    order = sorted((((-(1 << 63) if i is None else i), t or "") for i, t, *_ in rows), key=place)
    following = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    prints = {(-(1 << 63) if r.doc_id is None else r.doc_id, r.edited_sha256): r for r in got}
    apart = []
    for (i, text), after in following.items():
        changed = P.edited(text, after)
        r = prints[(i, hashlib.sha256(changed.encode()).hexdigest())]
        assert r.fingerprint == own[hashlib.sha256(text.encode()).hexdigest()] and r.edited_fingerprint == P.digest(changed.encode())
        assert abs(r.near_edited - slow_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - slow_likeness(r.fingerprint, P.digest(after.encode()))) < 1e-12
        if i >= 200:
            apart.append((r.near_edited, r.near_next))
    assert sum(a > b for a, b in apart) >= 0.97 * len(apart)
    assert sum(a for a, _ in apart) / len(apart) > sum(b for _, b in apart) / len(apart) + 0.25


def test_ranges_follow_the_size(spark, monkeypatch):
    """Ranges hold a part of the input each, at most MOST_RANGES of them, and cuts of a sample deal the rows alike."""
    rows = [(k, f"text {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = expected(rows)
    for ranges, sample in ((7, 1000), (7, 20), (2, 1)):
        monkeypatch.setattr(P, "MOST_RANGES", ranges)
        monkeypatch.setattr(P, "RANGE_BYTES", 1)
        monkeypatch.setattr(P, "CUT_ROWS", sample)
        got = P.fingerprint_edits(df).collect()
        assert sorted(((r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest()) for r in got), key=repr) == wanted


def test_rows_of_one_id_are_many_tasks(spark, monkeypatch):
    """Most rows without a doc_id, others with one and the same: no task holds much more than its range, and the order stays."""
    from pyspark.sql import functions as F

    rows = [(None if k % 3 else 5, f"text {k}") for k in range(4000)] + [(9, "first"), (2, "x"), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = P.with_next(df, P.EDITED, P._pair, 8)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < len(rows) / 4
    assert sorted(((r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest()) for r in found.collect()), key=repr) == expected(rows)
