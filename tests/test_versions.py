"""Versions of a table: what is committed is seen whole, what is not is not."""

import json

import pytest
from pyspark.sql import functions as F

from stanzaline.sources import places
from stanzaline.sources.versions import Conflict, VersionedTable

SCHEMA = "id long, part string, v int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, *own):
    return spark.createDataFrame(list(own), SCHEMA)


def test_versions_and_dry_run(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"))
    assert store.numbers() == [] and rows(store.read(schema=SCHEMA)) == []
    with pytest.raises(ValueError):
        store.read()
    assert store.append(frame(spark, (1, "a", 1))).commit() == 1
    assert store.append(frame(spark, (2, "b", 2))).commit() == 2
    draft = store.replace(store.read().withColumn("v", (F.col("v") * 10).cast("int")))
    assert rows(draft.read()) == [(1, "a", 10), (2, "b", 20)] and rows(store.read()) == [(1, "a", 1), (2, "b", 2)]
    draft.commit()
    assert rows(store.read()) == [(1, "a", 10), (2, "b", 20)] and rows(store.read(1)) == [(1, "a", 1)] and rows(store.read(2)) == [(1, "a", 1), (2, "b", 2)]
    store.replace(frame(spark)).commit()
    assert rows(store.read()) == [] and store.numbers() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1,)], "id long"))


def test_partitions_are_swapped_together(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"), "part")
    store.append(frame(spark, (1, "a", 1), (2, "b", 2), (3, None, 3), (4, "a/b=c", 4), (5, "", 5))).commit()
    store.append(frame(spark, (6, "a", 6))).commit()
    store.replace_partitions(frame(spark, (7, "a", 7), (8, None, 8), (9, "new", 9)), ["b"]).commit()
    assert rows(store.read()) == sorted([(4, "a/b=c", 4), (5, "", 5), (7, "a", 7), (8, None, 8), (9, "new", 9)], key=repr)
    assert rows(store.read(2)) == sorted([(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "a/b=c", 4), (5, "", 5), (6, "a", 6)], key=repr)
    store.replace_partitions(frame(spark), ["a", None]).commit()
    assert rows(store.read()) == sorted([(4, "a/b=c", 4), (5, "", 5), (9, "new", 9)], key=repr)


def test_one_of_two_writers_wins(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"))
    store.append(frame(spark, (1, "a", 1))).commit()
    mine, other = store.append(frame(spark, (2, "b", 2))), VersionedTable(spark, str(tmp_path / "t")).append(frame(spark, (3, "c", 3)))
    other.commit()
    with pytest.raises(Conflict):
        mine.commit()
    assert rows(store.read()) == [(1, "a", 1), (3, "c", 3)]
    assert places.create(spark, str(tmp_path / "x/y"), "1") and not places.create(spark, str(tmp_path / "x/y"), "2")
    assert places.content(spark, str(tmp_path / "x/y")) == "1"


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path):
    """Half of the tasks write, another fails: readers go on with the old rows, and the next write succeeds."""
    store = VersionedTable(spark, str(tmp_path / "t"), "part")
    store.append(frame(spark, *((i, f"p{i % 4}", i) for i in range(40)))).commit()
    before = rows(store.read())
    broken = store.read().repartition(8).withColumn("v", F.when(F.col("id") == 17, F.raise_error(F.lit("lost")).cast("int")).otherwise(0))
    with pytest.raises(Exception, match="lost"):
        store.replace_partitions(broken)
    assert rows(store.read()) == before and store.numbers() == [1]
    store.replace_partitions(store.read().where("part = 'p1'").withColumn("v", F.lit(0))).commit()
    assert sum(r[2] == 0 for r in rows(store.read())) == 11
    # a manifest that was begun and never finished is no version
    (tmp_path / "t/versions/0000000003.json.half").write_text("{")
    assert store.numbers() == [1, 2]


def test_vacuum(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"), "part")
    store.append(frame(spark, (1, "a", 1), (2, "b", 2))).commit()
    store.replace_partitions(frame(spark, (3, "a", 3))).commit()
    store.append(frame(spark, (9, "z", 9)))  # never committed
    store.vacuum()
    assert store.numbers() == [2] and rows(store.read()) == [(2, "b", 2), (3, "a", 3)]
    kept = [f for p in (tmp_path / "t/rows").rglob("*.parquet") for f in [p.parent.name]]
    assert len(set(kept)) == 2
    assert set(json.loads(places.content(spark, str(tmp_path / "t/versions/0000000002.json")))) == {"schema", "folders"}


def test_folders_are_cleared(spark):
    path = places.fresh_folder(spark, "some")
    spark.range(3).write.parquet(path)
    places.clear(spark)
    assert places.names(spark, path) == []
