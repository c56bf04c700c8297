import random

from awkward import awkward_rows, prose
from stanzaline.llm import lines as L


def order(i):
    return (1 << 63) - 1 if i is None else i


def runs(lines):
    """Shortest runs of lines with MIN_BLOCK characters, from each line on and up to each line."""
    sizes = [len(x.strip(" ")) for x in lines]
    out = set()
    for k in range(len(lines)):
        end = next((e for e in range(k + 1, len(lines) + 1) if sum(sizes[k:e]) >= L.MIN_BLOCK), None)
        if end:
            out.add((k, end))
        start = next((s for s in range(k, -1, -1) if sum(sizes[s : k + 1]) >= L.MIN_BLOCK), None)
        if start is not None:
            out.add((start, k + 1))
    return out


def chain(pairs):
    """Longest run of pairs with increasing second numbers; of several that whose last pairs come latest."""
    best = []
    for k, (_, v) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(k) if pairs[j][1] < v), default=0))
    out, size, below = [], max(best, default=0), float("inf")
    for k in range(len(pairs) - 1, -1, -1):
        if best[k] == size and pairs[k][1] < below:
            out.append(pairs[k])
            size, below = size - 1, pairs[k][1]
    return out[::-1]


def patience(a, b, i=0, j=0):
    """Aligned lines of a and b, which begin at i and j, by recursion."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *patience(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*patience(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    once = chain([(k, b.index(x)) for k, x in enumerate(a) if a.count(x) == 1 == b.count(x)])
    if not once:
        numbered = lambda lines: [(x, lines[:k].count(x)) for k, x in enumerate(lines)]
        na, nb = numbered(a), numbered(b)
        once = chain([(k, nb.index(x)) for k, x in enumerate(na) if x in nb])
    out, (s, t) = [], (0, 0)
    for k, m in [*once, (len(a), len(b))] if once else []:
        out += patience(a[s:k], b[t:m], i + s, j + t) + [(i + k, j + m)]
        s, t = k + 1, m + 1
    return out[:-1] if once else []


def aligned_blocks(a, b):
    """Lines of b in aligned blocks of MIN_BLOCK characters."""
    pairs, gone = set(patience(a, b)), set()
    for i, j in pairs:
        if (i - 1, j - 1) not in pairs:
            n = next(n for n in range(1, len(b) + 2) if (i + n, j + n) not in pairs)
            if sum(len(x.strip(" ")) for x in b[j : j + n]) >= L.MIN_BLOCK:
                gone |= set(range(j, j + n))
    return gone


def cuts(rows, gone=aligned_blocks):
    """Line numbers that go, by (order, text). Rows that tie on doc_id must share nothing."""
    docs = sorted({(order(i), t) for i, t, *_ in rows if t})
    first, cut = {}, {}
    for d, (_, text) in enumerate(docs):
        lines = text.split("\n")
        own, spans = sorted(runs(lines)), {}
        for s, e in own:
            if tuple(lines[s:e]) in first:
                early, p = first[tuple(lines[s:e])]
                x = spans.setdefault(early, (s, e, p, p + e - s))
                spans[early] = min(x[0], s), max(x[1], e), min(x[2], p), max(x[3], p + e - s)
        for early, (s, e, p, q) in spans.items():
            cut.setdefault(docs[d], set()).update(s + k for k in gone(docs[early][1].split("\n")[p:q], lines[s:e]))
        for s, e in own:
            first.setdefault(tuple(lines[s:e]), (d, s))
    return cut


def everything(rows):
    """Lines of windows that any earlier document has, in whatever order: what there is to remove at most."""
    seen, cut = set(), {}
    for i, text in sorted({(order(i), t) for i, t, *_ in rows if t}):
        lines = text.split("\n")
        own = [(s, e, tuple(lines[s:e])) for s, e in runs(lines)]
        for s, e, run in own:
            if run in seen:
                cut.setdefault((i, text), set()).update(range(s, e))
        seen |= {run for _, _, run in own}
    return cut


def result(cut, i, t):
    gone = cut.get((order(i), t), set())
    kept = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return i, 0 if t is None else len(t.split("\n")), len(gone), kept


def brute(rows):
    cut = cuts(rows)
    return sorted((result(cut, i, t) for i, t, *_ in rows), key=repr)


def found(df):
    return sorted(((r.doc_id, r.line_count, r.line_removed, r.line_kept) for r in L.dedup_lines(df).collect()), key=repr)


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_align_is_increasing_and_equal():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    for _ in range(100):  # of elements without repetitions patience keeps as many as any order can
        a, b = (rng.sample(range(15), 10) for _ in range(2))
        assert len(L.align(a, b)) == longest_common(a, b)
    assert L.align(list(range(50)), list(range(50))) == [(i, i) for i in range(50)]


def test_alignment_by_definition():
    rng = random.Random(6)
    for n in (3, 6, 20):
        for _ in range(300):
            a, b = ([rng.randrange(n) for _ in range(rng.randrange(14))] for _ in range(2))
            assert L.align(a, b) == patience(a, b)
            lines_a, lines_b = ([f"{v} " + "x" * (9 + 6 * v) for v in x] for x in (a, b))
            got = {k for s, e in L.blocks(a, b, [len(x) for x in lines_b]) for k in range(s, e)}
            assert got == aligned_blocks(lines_a, lines_b)


def test_long_alignments():
    """Long documents in the opposite order, or of one line over and over, cost no more than others."""
    import time

    began = time.time()
    n = 20_000
    assert len(L.align(list(range(n)), list(range(n))[::-1])) == 1
    assert len(L.align([1, 2] * n, [3, 1, 2] * n)) >= 2 * n
    assert len(L.align([1, 2] * n, [2, 2, 1, 1] * n)) >= n
    assert time.time() - began < 20


def test_awkward(docs, clashing, no_docs):
    wanted = brute(awkward_rows())
    assert found(docs) == wanted
    assert L.dedup_lines(no_docs).count() == 0
    assert L.dedup_lines(docs).columns == [*docs.columns, "line_count", "line_removed", "line_kept"]
    got = L.dedup_lines(clashing)
    assert got.columns == [*clashing.columns, "_line_count", "_line_removed", "line_kept"]
    rows = got.collect()
    assert sorted(((r.doc_id, r._line_count, r._line_removed, r.line_kept) for r in rows), key=repr) == wanted
    assert all({r[c] for c in clashing.columns[5:]} == {1} for r in rows)


def test_passages(spark):
    rng = random.Random(5)
    shared = [prose(rng, rng.randrange(3, 12)) for _ in range(12)]
    rows = []
    for i in range(50):
        own = [prose(rng, rng.randrange(1, 8)) for _ in range(rng.randrange(1, 6))]
        at = rng.randrange(10)
        own[rng.randrange(len(own) + 1) : 0] = shared[at : at + rng.randrange(4)]
        if i % 2:
            own.append(shared[11])
        rows.append((i * 7 % 50, "\n".join(own)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows) and sum(r[2] for r in got) > 20


def test_number_of_carriers_does_not_matter(spark):
    """A block of two lines, each of which an earlier document has alone, goes from all copies but the first."""
    a, b = "line a " + "x" * 40, "line b " + "y" * 41
    for n in (2, 3, 4, 6, 12):
        rows = [(0, f"{a}\nown start of the first"), (1, f"own start of the second\n{b}")]
        rows += [(i, f"own {i} {i * i}\n{a}\n{b}\nend {i}") for i in range(2, 2 + n)]
        got = found(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got == brute(rows)
        assert sorted((r[0], r[2]) for r in got) == [(0, 0), (1, 0), *((i, 2) for i in range(2, 2 + n))]


def test_the_alignment_decides(spark):
    """Of blocks in another order, and of repetitions that the partner has not, some stay that taking every common window would remove."""
    rng = random.Random(8)
    a, b, c = ("abc"[k] * 3 + " " + prose(rng, 9) for k in range(3))
    rows = [(0, "\n".join([a, prose(rng, 9), b, c])), (1, "\n".join([b, c, a])), (2, "\n".join([prose(rng, 9), a, prose(rng, 9), a])), (3, "\n".join([a, "other", b, c]))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows) != sorted((result(everything(rows), *r) for r in rows), key=repr)
    kept = {r[0]: r[3] for r in got}
    assert [r[2] for r in got] == [0, 2, 1, 3] and kept[1] == a and kept[3] == "other"


def test_recall(spark):
    """Blocks that documents take from earlier ones in their order go, with few exceptions."""
    rng = random.Random(12)
    rows = []
    for i in range(120):
        own = [prose(rng, rng.randrange(3, 9)) for _ in range(rng.randrange(3, 9))]
        if rows:
            source = rng.choice(rows)[1].split("\n")
            at = rng.randrange(len(source))
            own[rng.randrange(len(own)) : 0] = source[at : at + rng.randrange(1, 9)]
            own.insert(rng.randrange(len(own)), rng.choice(rng.choice(rows)[1].split("\n")))
        rows.append((i, "\n".join(own)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows)
    most = sum(map(len, everything(rows).values()))
    assert most > 100 and 0.9 * most <= sum(r[2] for r in got) <= most


def test_many_common_lines(spark, monkeypatch):
    """Lines of many carriers, in any order and number, also where their keys are dealt to several tasks."""
    from stanzaline.llm import common

    for seed in range(3):
        monkeypatch.setattr(common, "KEY_ROWS", 3 if seed else 1_000)
        rng = random.Random(seed)
        shared = [prose(rng, rng.randrange(1, 9)) for _ in range(6)] + [""]
        near = [prose(rng, 8) for _ in range(40)]
        rows = []
        for i in range(160):
            own = [rng.choice(shared) if rng.random() < 0.6 else rng.choice(near) if rng.random() < 0.3 else prose(rng, 6) for _ in range(rng.randrange(1, 7))]
            rows.append((i * 7 % 160, "\n".join(own)))
        got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert got == brute(rows)


def test_short_lines(spark):
    """Documents that share nothing but short lines."""
    poem = "\n".join(f"short line {k}" for k in range(6))
    rows = [(0, poem), (1, "other\n" + poem), (2, poem), (3, "short line 1\nshort line 2"), (4, "short line 1\nno")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and [r[2] for r in got] == [0, 6, 6, 0, 0]


def test_query(spark, tmp_path):
    """The registered query against the brute-force version."""
    import hashlib

    from stanzaline.llm import queries

    rows = awkward_rows() + [(100 + k, f"{prose(random.Random(k), 9)}\nthe same long line that all of these documents carry", None, None, None) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_lines(spark, str(tmp_path)).collect()
    wanted = [(i, n, gone, None if kept is None else hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(wanted, key=repr)
