"""Versioned tables: what a batch rewrites, what readers and writers of two sessions see, and what a lost writer leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.sources.artifacts import store_new
from weftline.sources.files import Folder
from weftline.sources.versioned import Conflict, VersionedTable

ROW = "id long, v string"


def rows(spark, *x):
    return spark.createDataFrame(list(x), ROW)


def content(table, number=None):
    return {r.id: r.v for r in table.read(number).collect()}


def test_a_small_batch_rewrites_its_buckets_alone(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", buckets=32)
    with pytest.raises(ValueError):
        table.read()
    assert table.upsert(spark.range(1000).select("id", F.lit("a").alias("v"))) == 1
    before = table.version()
    changed = spark.range(0, 1000, 100).select("id", F.lit("b").alias("v"))  # one key in a hundred
    touched = set(table._touched(changed, 32))
    assert table.upsert(changed) == 2 and 0 < len(touched) <= 10
    after = table.version()
    assert {b for b in before.folders if before.folders[b] != after.folders[b]} == touched
    assert content(table) == {k: "b" if k % 100 == 0 else "a" for k in range(1000)} and set(content(table, 1).values()) == {"a"}
    found = table.lookup(spark.range(3))
    assert {r.id: r.v for r in found.collect()} == {0: "b", 1: "a", 2: "a"} and len(found.inputFiles()) < len(table.read().inputFiles()) / 4
    assert len(table.vacuum()) == len(touched) and table.numbers() == [2] and len(content(table)) == 1000


def test_batches_count_once_and_the_last_row_of_a_key_wins(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", buckets=4)
    batch = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "null", 1), (2, "x", None)], "id long, v string, at int")
    assert table.upsert(batch, order="at", batch="one") == 1 == table.upsert(rows(spark, (1, "other")), batch="one")
    assert content(table) == {1: "new", None: "null", 2: "x"}
    assert table.upsert(rows(spark, (None, "again"), (3, "y"))) == 2 and content(table) == {1: "new", None: "again", 2: "x", 3: "y"}
    assert {r.id: r["at"] for r in table.read().collect()}[3] is None
    assert table.delete(rows(spark, (2, ""), (9, "")), batch="gone") == 3 == table.delete(rows(spark, (1, "")), batch="gone") and set(content(table)) == {1, None, 3}
    assert table.upsert(rows(spark)) == 4 and set(content(table)) == {1, None, 3}
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("1", "x")], "id string, v string"))


def test_readers_see_one_version_while_another_session_commits(spark, tmp_path):
    own = VersionedTable(spark, f"file://{tmp_path}/t", "id", buckets=8)
    own.upsert(spark.range(200).select("id", F.lit("a").alias("v")))
    reader = VersionedTable(spark.newSession(), own.folder.path, "id")
    held = reader.read()  # its files are those of version 1, whatever comes
    seen = []

    class Watched(VersionedTable):
        def _next(self, *args):
            seen.append(set(content(reader).values()))  # all is written, nothing is committed
            return super()._next(*args)

    Watched(spark, own.folder.path, "id").upsert(spark.range(200).select("id", F.lit("b").alias("v")))
    assert seen == [{"a"}] and set(content(reader).values()) == {"b"} and {r.v for r in held.collect()} == {"a"}


@pytest.mark.parametrize("other", [[(1, "theirs")], [(2, "theirs")]])
def test_two_writers_lose_nothing(spark, tmp_path, other):
    path = f"file://{tmp_path}/t"
    VersionedTable(spark, path, "id", buckets=8).upsert(rows(spark, (1, "a"), (2, "a"), (3, "a")))
    writes, first = [], [True]

    class Second(VersionedTable):
        def _next(self, *args):
            if first.pop() if first else False:  # the other writer is first, once
                VersionedTable(self.spark.newSession(), path, "id").upsert(rows(self.spark.newSession(), *other))
            return super()._next(*args)

        def _write(self, *args):
            writes.append(args[3])
            return super()._write(*args)

    table = Second(spark, path, "id")
    assert table.upsert(rows(spark, (1, "ours"))) == 3
    assert content(table) == {1: "ours", 2: dict(other).get(2, "a"), 3: "a"}
    same = other[0][0] == 1 or table._touched(rows(spark, *other), 8) == writes[0]
    assert len(writes) == (2 if same else 1)  # other buckets need no second merge


def test_a_lost_writer_leaves_nothing_that_is_read(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", buckets=4)
    table.upsert(rows(spark, (1, "a")))

    class Lost(VersionedTable):
        def _next(self, *args):
            raise RuntimeError("lost")

    class Late(VersionedTable):
        def _next(self, *args):
            return False

    with pytest.raises(RuntimeError, match="lost"):
        Lost(spark, table.folder.path, "id").upsert(rows(spark, (1, "b"), (2, "b")))
    with pytest.raises(Conflict):
        Late(spark, table.folder.path, "id").upsert(rows(spark, (1, "c")))
    assert content(table) == {1: "a"} and len(table.vacuum()) == 2 and content(table) == {1: "a"}


def test_files_are_put_in_place_whole(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/f")
    assert folder.read("x.json") is None and folder.names() == [] and folder.claim("a/x.json", {"k": 1}) and not folder.claim("a/x.json", {"k": 2})
    folder.replace("a/x.json", {"k": 3})
    assert folder.read("a/x.json") == {"k": 3} and folder.names("a") == ["x.json"] and folder.names("_made") == []


def test_a_replaced_table_is_found_again_after_a_lost_driver(spark, tmp_path):
    at = f"{tmp_path}/pages"
    store_new(rows(spark, (1, "a"), (2, "a")), at, "id")
    rows(spark, (1, "b"), (2, "a")).write.parquet(f"{at}.next")
    Folder(spark, str(tmp_path)).delete("pages")  # lost between taking the old table away and putting the new one there
    assert store_new(rows(spark, (3, "c")), at, "id").count() == 1
    assert {r.id: r.v for r in spark.read.parquet(at).collect()} == {1: "b", 2: "a", 3: "c"}
