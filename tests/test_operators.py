"""Sequence algorithms, search and scalars against plain Python."""

import datetime as dt
import hashlib
import itertools
import random

from pyspark.sql import functions as F

from stanzaline.functions import scalars as D
from stanzaline.functions import text as T
from stanzaline.operators import search as S
from stanzaline.operators import sequences as Q
from stanzaline.operators import windows as W


def test_longest_chain():
    rng = random.Random(1)
    for _ in range(60):
        keys = [rng.randrange(6) for _ in range(rng.randrange(9))]
        best = max((len(c) for n in range(len(keys) + 1) for c in itertools.combinations(keys, n) if list(c) == sorted(c)), default=0)
        chain = Q.longest_chain(keys)
        assert len(chain) == best and [keys[i] for i in chain] == sorted(keys[i] for i in chain) and chain == sorted(chain)


def test_recover_numbers():
    assert Q.recover_numbers(["1", "2", "x", "l", "4", "S"], 9) == [(0, 1, False), (1, 2, False), (4, 4, True), (5, 5, True)]
    assert Q.recover_numbers(["1", "2", "6"], 9, gaps=[(3, 5)]) == [(0, 1, False), (1, 2, False), (2, 6, True)]
    assert Q.recover_numbers(["1", "40"], 99) == [(0, 1, False)]
    assert Q.best_start(["9", "l", "x", "1", "2", "3", "4"], 9) == 3
    assert Q.recover_numbers(["1", "2", "abc", "4"], 9, anchored=True) == [(0, 1, False), (1, 2, False), (2, 3, True), (3, 4, False)]
    assert Q.recover_numbers(["1", "2", "the", "4"], 9, anchored=True) == [(0, 1, False), (1, 2, False), (3, 4, True)] == Q.recover_numbers(["1", "2", "abc", "4"], 9)


def test_align():
    verses = ["in the beginning god".split(), "and the earth was".split(), "let there be light".split()]
    found = Q.align_phrases([["beginning"], ["earth", "was"], ["in", "beginning"], ["3"], ["be", "x", "light"], ["zz"]], verses)
    assert found == [(1, "strong"), (2, "strong"), (0, "dropped"), (3, "anchor"), (3, "weak"), (0, "dropped")]
    assert Q.ordered_words(["a", "c"], ["a", "b", "c"]) == ("strong", 3)


def test_machines():
    assert Q.trigger_sections(["title", "O Lord open", "more", "Here endeth", "O Lord open"], [("o lord", "opening"), ("here", "end")]) == ["", "opening", "opening", "end", "end"]
    assert Q.classify_blocks(["[note]", "THE ORDER", "V. O Lord", "_then_", "Our Father"]) == [("heading", "note"), ("cue", ""), ("rubric", ""), ("text", "")]


def test_porter():
    wanted = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "digitizer": "digit", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "adoption": "adopt", "effective": "effect", "probate": "probat", "controll": "control", "rate": "rate", "sky": "sky"}
    assert {w: S.porter(w) for w in wanted} == wanted


def test_dates(spark):
    days = [dt.date(2024, 2, 29), dt.date(2025, 3, 1), dt.date(2025, 2, 28), dt.date(1900, 3, 1), dt.date(2000, 12, 31)]
    got = [r.n for r in spark.createDataFrame([(d,) for d in days], "d date").select(D.leap_day_of_year("d").alias("n")).collect()]
    assert got == [60, 61, 59, 61, 366]


def test_hash_modulo(spark):
    texts = ["", "a", "2026-09-20|en", "é"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.hash_modulo("t", F.lit(31102)).alias("n")).collect()]
    assert got == [int(hashlib.sha256(t.encode()).hexdigest(), 16) % 31102 for t in texts]


def test_keywords(spark):
    got = spark.createDataFrame([("[is] shepherd/ my I lack",), (None,)], "t string").select(T.keywords("t").alias("k")).collect()
    assert [r.k for r in got] == [["shepherd", "lack"], []]


def test_html(spark):
    raw = '<p title="a>b">x&nbsp;&eacute;<br>y  </p>\n\n\n\nz'
    assert spark.createDataFrame([(raw,)], "h string").select(T.html_text("h").alias("t")).first().t == "x é\ny\n\nz"
    assert T.render_wiki("{{a|{{b|x}}|k=v}} [[t|n]] ''i''<ref>r</ref>") == "x n i"


def test_mend(spark):
    broken = "â\x80\x9cAâ\x80\x9d it\x92s so"
    assert spark.createDataFrame([(broken,)], "t string").select(T.mend_encoding("t").alias("t")).first().t == "“A” it’s so"


def test_repair_ranges(spark):
    df = spark.sql("select array(named_struct('s', 3, 'e', 5), named_struct('s', 4, 'e', 4), named_struct('s', 9, 'e', 9)) r")
    got = df.select(W.repair_ranges(F.col("r"), F.lit(20)).alias("r")).first().r
    assert [tuple(x) for x in got] == [(1, 5), (6, 6), (9, 20)]
