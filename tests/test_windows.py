"""Windows and steps on many groups, against plain Python."""

import html
import random

import pandas as pd

from stanzaline.functions import text as T
from stanzaline.operators import scans, sequences, windows
from stanzaline.plans import registry
from stanzaline.sources import readers


def _runs(values):
    out = []
    for v in sorted({v for v in values if v is not None}):
        if out and v == out[-1][1] + 1:
            out[-1] = (out[-1][0], v, out[-1][2] + 1)
        else:
            out.append((v, v, 1))
    return out + [(None, None, 1)] * (None in values)


def test_islands_without_a_hash_of_rows(spark):
    rng = random.Random(2)
    groups = {g: [rng.choice([None, *range(rng.randrange(1, 40))]) for _ in range(rng.randrange(1, 60))] for g in [None, *range(30)]}
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g long, v long").repartition(5)
    made = windows.islands(df, ["g"], "v")
    assert sorted(map(str, made.collect())) == sorted(f"Row(g={g}, low={a}, high={b}, n={n})" for g, own in groups.items() for a, b, n in _runs(own))
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_blocks_by_a_tree_of_cuts(spark, monkeypatch):
    """Three levels; no row is joined with more cuts than a node has, and places are those of a plain search."""
    monkeypatch.setattr(scans, "FAN", 4)
    rows = [(k % 2 if k % 7 else None, (k * 7919) % 2003) for k in range(2003)] + [(9, 1), (9, None)]
    df = spark.createDataFrame(rows, "g int, k int")
    for group in (["g"], []):
        blocks = scans.Blocks(df, group, ["k"], rows=40)
        cuts = {}
        for r in blocks._cuts(blocks.df, 40).collect():
            cuts.setdefault(r["g"] if group else 0, []).append(r["key"]["k0"])
        got = blocks.df.collect()
        assert len(got) == len(rows) and max(len(c) for c in cuts.values()) > 16
        for r in got:
            own = cuts.get(r["g"] if group else 0)
            assert r[blocks.block] == (None if own is None else sum(r["k"] is not None and c <= r["k"] for c in own)), r
        numbered = scans.number(df, group, ["k"], rows=40).collect()
        seen = {}
        for r in sorted(numbered, key=lambda r: (r["k"] is not None, r["k"] or 0)):
            seen.setdefault(r["g"] if group else 0, []).append(r["n"])
        assert all(own == list(range(1, len(own) + 1)) for own in seen.values())


def test_references_alone_go_to_python(spark):
    texts = [None, "", "&", "&amp", "&amp;amp; &notit; x", "a&#65;b&#x42c;&#0;&#xD800;&#1234567890;", "&copy&copy;&&lt;", "&" + "x" * 40 + ";", "é&eacute;\n&nbsp;&\t;", "no end &#", "😀&NotEqualTilde;😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = df.select("i", T.unescape_all("t").alias("u"))
    assert {r["i"]: r["u"] for r in made.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" in plan


def test_many_groups_go_to_python_at_once(spark):
    """No grouped map, whose cost is that of a frame for each group."""
    every = registry.queries()
    for name in ("q11_blocks", "j20_phrases"):
        plan = every[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan and "FlatMap" not in plan, name


def test_phrases_of_groups_without_verses(spark):
    verses = spark.createDataFrame([(1, 1, ["in", "the", "days"]), (1, 2, ["of", "old"]), (None, 5, ["so", "it", "was"])], "g int, v int, words array<string>")
    phrases = spark.createDataFrame([(1, 2, ["of", "old"]), (1, 1, ["the", "days"]), (2, 1, ["lost"]), (None, 3, ["it", "was"])], "g int, s int, words array<string>")
    got = sequences.align_to_verses(phrases, verses, ["g"], "s", "v")
    assert got.dtypes == [("g", "int"), ("s", "int"), ("verse", "bigint"), ("strength", "string")]
    assert {(r.g, r.s, r.verse, r.strength) for r in got.collect()} == {(1, 1, 1, "strong"), (1, 2, 2, "strong"), (2, 1, None, "dropped"), (None, 3, 5, "strong")}


def test_segments_of_parts_of_a_batch():
    """What a batch of many texts gives comes in parts, so that not all its rows are there at once."""

    class Texts:
        select = lambda self, *_: self
        mapInPandas = lambda self, walk, _: walk

    body = '<book id="RUT"><c id="1"/><v id="1"/>In the <f>note</f>days<v id="2"/>of old'
    frames = list(readers.segment_walk(Texts())(iter([pd.DataFrame({"body": [body, None, ""] * 200})])))
    assert len(frames) > 3 and max(map(len, frames)) <= 256
    assert pd.concat(frames).values.tolist() == [["RUT", 1, 1, "In the days"], ["RUT", 1, 2, "of old"]] * 200
