"""A segmented keyword index against one built anew, after adds, changes, deletes and merges."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import bm25
from weftline.sources.segments import SegmentedIndex

QUERIES = [(k, q) for k, q in enumerate(["alpha beta", "w001 w002 w003 w001", "w004", "nowhere", "w000 w010 w100 alpha"])]


def text(rng):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % 200:03d}" for _ in range(rng.randint(0, 40)))


def same(spark, index, docs, k=10):
    queries = spark.createDataFrame(QUERIES, "q int, text string")
    table = spark.createDataFrame(sorted(docs.items()), "id int, text string")
    got, want = ({tuple(r) for r in x.withColumn("distance", F.round("distance", 5)).collect()} for x in (index.top_k(queries, k, "q", "text"), bm25.top_k(table, queries, k, "id", "text", "q", "text")))
    assert got == want
    state = index.state()
    assert state.n == len(docs) and state.length == sum(len([w for w in t.split() if len(w) > 1]) for t in docs.values())


def test_batches_and_merges_give_the_scores_of_a_new_index(spark, tmp_path):
    rng, docs = random.Random(12), {}
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    with pytest.raises(ValueError):
        index.index()
    frame = lambda x: spark.createDataFrame(list(x.items()), "id int, text string")
    for step in range(4):
        added = {rng.randint(0, 90): text(rng) + " alpha" * (step % 2) for _ in range(40)}
        gone = rng.sample(sorted(docs), 8) if docs else []
        gone = [k for k in gone if k not in added]
        before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")} if step else {}
        assert index.apply(frame(added), deleted=frame(dict.fromkeys(gone, "")) if gone else None, batch=f"b{step}") == step + 1
        assert index.apply(frame({1: "again"}), batch=f"b{step}") == step + 1
        docs = {k: v for k, v in docs.items() if k not in gone} | added
        after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
        assert before.items() <= after.items()  # nothing older was written again
        assert len(index.state().segments) == step + 1
        if step:
            same(spark, index, docs)
    assert len(index.due()) == 4 and index.merge() and len(index.state().segments) == 1 and not index.merge() and index.state().gone == []
    same(spark, index, docs)
    index.apply(deleted=frame({k: "" for k in list(docs)[:5]} | {999: ""}))
    docs = {k: v for k, v in docs.items() if k not in list(docs)[:5]}
    same(spark, index, docs)
    assert os.listdir(tmp_path / "i" / "segments") and index.apply(frame({7: "alpha beta"})) and index.top_k(spark.createDataFrame([(1, "beta")], "q int, text string"), 3, "q", "text").first().id == 7


def test_of_two_writers_the_second_starts_again(spark, tmp_path):
    path, frame = f"file://{tmp_path}/i", lambda *x: spark.createDataFrame(list(x), "id int, text string")
    SegmentedIndex(spark, path).apply(frame((1, "alpha"), (2, "beta")))
    first = [True]

    class Second(SegmentedIndex):
        def _commit(self, state):
            if first and first.pop():
                SegmentedIndex(self.spark, path).apply(frame((1, "alpha alpha"), (3, "gamma")))
            return super()._commit(state)

    assert Second(spark, path).apply(frame((1, "delta"))) == 3
    index = SegmentedIndex(spark, path)
    found = lambda q: [r.id for r in index.top_k(spark.createDataFrame([(0, q)], "q int, text string"), 5, "q", "text").collect()]
    assert (found("alpha"), found("delta"), sorted(found("gamma beta")), index.state().n) == ([], [1], [2, 3], 3)
    with pytest.raises(ValueError):
        index.apply(frame((None, "x")))
