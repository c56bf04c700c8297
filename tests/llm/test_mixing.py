import re
from collections import defaultdict

from pyspark.sql import functions as F

from stanzaline.llm import mixing as M
from awkward import awkward_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def test_targets():
    assert M.targets([10, 10], [3, 1]) == [20.0, 10.0]
    assert M.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    assert M.targets([], []) == [] and M.targets([0, 0], [1, 1]) == [0.0, 0.0]
    assert sum(M.targets([5, 50, 7, 900], [3, 1, 2, 3])) == 1.5 * 962
    got = M.source_targets([(None, 5), ("b", 5), ("a", 5)])
    assert [s for s, _, _ in got] == ["a", "b", None]


def test_mix(docs, clashing):
    rows = awkward_rows()
    totals = defaultdict(int)
    for _, t, _, s, _ in rows:
        totals[s] += size(t)
    goal = {s: t for s, _, t in M.source_targets(list(totals.items()))}
    for df in (docs, clashing):
        mixed = M.mix(df)
        made = [c for c in mixed.columns if c not in df.columns]
        assert mixed.columns == [*df.columns, *made] and [c.lstrip("_") for c in made] == ["mix_size", "mix_source_size", "mix_target", "mix_taken"]
        got = [(r, r[made[0]], r[made[1]], r[made[2]], r[made[3]]) for r in mixed.collect()]
        assert all(r[c] == 1 for r, *_ in got for c in df.columns[5:])
        assert sorted((r.doc_id is None, r.doc_id or 0, n) for r, n, *_ in got) == sorted((i is None, i or 0, size(t)) for i, t, *_ in rows)
        taken = defaultdict(int)
        for r, n, whole, target, took in got:
            assert whole == totals[r.source] and target == goal[r.source] and 0 <= took <= 2 * n
            taken[r.source] += took
        assert all(abs(taken[s] - goal[s]) <= 0.5 for s in totals)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.mix_size, r.mix_taken)
    assert sorted(map(key, M.mix(docs).collect())) == sorted(map(key, M.mix(docs.repartition(5)).collect()))


def test_missing_ids_are_spread(spark):
    """Documents without a doc_id have keys of their own, so the cut divides them like any others."""
    rows = [(None, f"w{k} " * (1 + k % 9), "s") for k in range(3000)] + [(k, "x " * 5, "t") for k in range(3000)]
    for each in (16, 1024):
        M.BUCKET_ROWS, kept = each, M.BUCKET_ROWS
        try:
            got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.7).collect()
        finally:
            M.BUCKET_ROWS = kept
        for s in "st":
            own = [r for r in got if r.source == s]
            part = [r for r in own if r.mix_taken % r.mix_size]
            assert abs(sum(r.mix_taken for r in own) - own[0].mix_target) <= 0.5 and len(part) <= 1


def test_query(spark, tmp_path):
    """The registered query against sizes, targets and cuts by plain Python."""
    from stanzaline.llm import queries

    rows = awkward_rows() + [(500 + k, "w " * (k % 90), "en", f"src{k % 5}", 1) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_mixing(spark, str(tmp_path)).collect()
    totals, source = defaultdict(int), {}
    for i, t, _, s, _ in rows:
        totals[s] += size(t)
        source[(i, size(t))] = s
    # targets by water filling, in small steps of the level
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    low, high, whole = 0.0, 1e9, 1.5 * sum(totals.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * totals[s]) for s in order) < whole else (low, level)
    taken = defaultdict(int)
    for r in got:
        s = source[(r.doc_id, r.size)]
        taken[s] += r.taken
        assert r.source_size == totals[s] and abs(r.target - min(low * weight[s], 2 * totals[s])) < 1e-3 and 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - min(low * weight[s], 2 * totals[s])) <= 0.51 for s in order)


def test_many_sources(docs, monkeypatch):
    """Cuts of more sources than may be broadcast are joined otherwise, with the same result."""
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.mix_size, r.mix_taken)
    wanted = sorted(map(key, M.mix(docs).collect()))
    monkeypatch.setattr(M, "MOST_BROADCAST", 0)
    assert sorted(map(key, M.mix(docs).collect())) == wanted
    monkeypatch.setattr("stanzaline.llm.common.KEY_ROWS", 2)  # and large sources are dealt out
    named = docs.withColumnsRenamed({"n_chars": "n", "lang": "hot_salt"})
    assert sorted(map(key, M.mix(named).collect())) == wanted


def test_buckets_of_very_many_rows(spark):
    """Keys in 2^27 buckets, as of 10^11 documents."""
    count = 1 << 27
    keys = [0, 1, (1 << 13) - 1, 1 << 13, (1 << 39), (1 << 40) - 1]
    got = [r.b for r in spark.createDataFrame([(k,) for k in keys], "k long").select(M._bucket(F.col("k"), count).alias("b")).collect()]
    assert got == [k * count >> 40 for k in keys] and got[-1] == count - 1


def test_many_buckets(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(5000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, goal = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.mix_taken
        goal[r.source] = r.mix_target
    assert len(got) == 5000 and all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)


def test_documents_whole(docs, clashing, no_docs):
    got = M.mixed_documents(docs)
    assert got.columns == docs.columns
    other = M.mixed_documents(clashing)
    assert other.columns == clashing.columns and all({r[c] for c in clashing.columns[5:]} == {1} for r in other.collect())
    known = {(i, t) for i, t, *_ in awkward_rows()}
    assert all((r.doc_id, r.text) in known for r in got.collect())
    assert M.mix(no_docs).count() == 0 and M.mixed_documents(no_docs).count() == 0
