"""Each stage of the pipeline on its own input, against a brute-force version."""

import functools
import random
from collections import Counter

import pytest
import test_lines
import test_neardup
import test_packing
from awkward import awkward_rows, prose
from tokenizers import Tokenizer

import corpus_pipeline as C
from stanzaline.llm import mixing, packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(21)
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in awkward_rows()]
    shared = "\n".join(prose(rng, 12) for _ in range(3))
    for i in range(100, 160):
        text = prose(rng, rng.randrange(20, 90))
        if i % 4 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 5 == 0:
            text += "\n" + shared + "\n" + prose(rng, 30)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(100, 160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(autouse=True)
def short_fit(monkeypatch):
    monkeypatch.setattr(quality, "fit", functools.partial(quality.fit, steps=120))


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        if name != "pack":
            assert out.columns == COLUMNS and dict(out.dtypes)["n_chars"] == "bigint"
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))

    before, after = rows_of(seen["documents"]), rows_of(seen["quality"])
    model = quality.train(seen["documents"], spark.read.parquet(f"{folder}/labels.parquet"))
    assert Counter(after) == Counter(r for r in before if quality.score(model, (r[1] or "").encode()) >= quality.THRESHOLD)

    before, after = after, rows_of(seen["lines"])
    cut, kept = test_lines.cuts(before), Counter()
    for i, t, lang, source, n in before:
        _, _, removed, text = test_lines.result(cut, i, t)
        if not removed or text.strip():
            kept[(i, text, lang, source, len(text) if removed else n)] += 1
    assert Counter(after) == kept

    before, after = after, rows_of(seen["neardup"])
    # the least of each group by doc_id, nulls last; a tie leaves one of its rows
    least = dict(zip(((r[0], r[1]) for r in before), test_neardup.group_list(before)))
    first = lambda r: (r[0] is None, r[0] or 0)
    bags = {r: test_neardup.bag(r[1]) for r in set(before)}
    wanted = Counter(r for r in set(before) if not bags[r] or all(first(r) <= first(o) for o in bags if bags[o] and test_neardup.jaccard(bags[r], bags[o]) >= 0.8))
    wanted = Counter(r for r in wanted if not bags[r] or least[(r[0], r[1])] == r[0])
    assert Counter(after) == wanted

    before, after = after, rows_of(seen["mix"])
    size = lambda t: len((t or "").encode().split())
    totals, taken, most = Counter(), Counter(), Counter()
    for r in before:
        totals[r[3]] += size(r[1])
        most[r[3]] = max(most[r[3]], size(r[1]))
    for r in after:
        taken[r[3]] += size(r[1])
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    for source, _, goal in mixing.source_targets(list(totals.items())):
        assert abs(taken[source] - goal) <= most[source] / 2 + 1

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    assert test_packing.check(after, tokenizer, seen["pack"].collect())


def test_run(spark, folder):
    out = C.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_clashing_names(spark, folder, clashing):
    """Columns that are named like those that the stages make come through every stage as they were."""
    docs = clashing
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        if name == "pack":
            assert out.count() > 0
        else:
            rows = out.collect()
            assert out.columns == clashing.columns and rows and all({r[c] for c in out.columns[5:]} == {1} for r in rows)


def test_run_clears_what_it_wrote(spark, folder):
    from stanzaline.llm import common

    common.clear(spark)
    assert C.run(spark, folder).count() > 0 and len(common._written) == 1
