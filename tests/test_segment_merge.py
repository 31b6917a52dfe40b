"""Merging of shards from postings to postings, and what frequencies lose, against the documents themselves."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from weftline.functions.text import terms
from weftline.operators import blockmax
from weftline.sources.segments import SegmentedIndex


def made(spark, docs: dict[int, str], parts: int, prefix: str):
    frame = spark.createDataFrame(sorted(docs.items()), "id long, text string").repartition(parts)
    return blockmax.shards(frame, "id", terms(F.col("text")), prefix=prefix).localCheckpoint()


def read(table) -> tuple[dict[int, Counter], dict[str, int]]:
    """What the shards say of every document, its tokens counted, and the documents of each shard."""
    rows = table.collect()
    heads = {r["shard"]: r for r in rows if r["token"] is None}
    found = {i: Counter() for r in heads.values() for i in r["ids"]}
    for r in rows:
        if r["token"] is not None:
            head = heads[r["shard"]]
            assert r["docs"] == sorted(r["docs"]) and r["blocks"] == sorted({d // blockmax.BLOCK for d in r["docs"]})
            assert r["block_tfs"] == [max(t for d, t in zip(r["docs"], r["tfs"], strict=True) if d // blockmax.BLOCK == b) for b in r["blocks"]]
            for d, tf in zip(r["docs"], r["tfs"], strict=True):
                found[head["ids"][d]][r["token"]] = tf
    for r in heads.values():
        assert r["lengths"] == sorted(r["lengths"]) == [sum(found[i].values()) for i in r["ids"]]
    return found, {k: len(r["ids"]) for k, r in heads.items()}


def test_a_merge_shuffles_a_row_for_each_token_of_a_shard(spark):
    rng = random.Random(5)
    docs = {k: " ".join(f"t{int(rng.paretovariate(0.7)) % 90:02d}" for _ in range(rng.randint(0, 30))) for k in range(400)}
    docs[400] = "alpha " * 5000  # a shard of its own by its words
    small, large = {k: v for k, v in docs.items() if k < 100 or k == 400}, {k: v for k, v in docs.items() if 100 <= k < 400}
    table = made(spark, small, 9, "a-").union(made(spark, large, 2, "b-")).localCheckpoint()
    heads = table.where("token IS NULL").select("shard", F.posexplode("ids").alias("place", "id"))
    dead = heads.where("id % 7 = 0 OR id = 3").select("shard", "place").localCheckpoint()
    live = {k: Counter(v.split()) for k, v in docs.items() if k % 7 and k != 3}
    merged = blockmax.merge(table, dead, "m-", docs_each=60, tokens_each=4000).localCheckpoint()
    found, sizes = read(merged)
    assert found == live
    assert 4 <= len(sizes) < 11 and max(sizes.values()) > 100  # small ones are together, large ones are not parted
    assert all(n <= 90 for n in sorted(sizes.values())[:-2])
    assert "explode" not in blockmax.merge(table, None, "m-")._jdf.queryExecution().toString()
    assert read(blockmax.merge(table, None, "n-"))[0] == {k: Counter(v.split()) for k, v in docs.items()}
    assert blockmax.merge(table, heads.select("shard", "place"), "o-").isEmpty()
    got = Counter({r["token"]: r["df"] for r in blockmax.lost(table, dead).groupBy("token").agg(F.sum("df").alias("df")).collect()})
    assert got == Counter(t for k, v in docs.items() if k % 7 == 0 or k == 3 for t in set(v.split()))


def test_an_id_twice_in_a_batch_counts_once(spark, tmp_path):
    rows = [(1, "alpha beta"), (1, "gamma"), (2, "beta"), (3, None), (1, "alpha beta")]
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.apply(spark.createDataFrame(rows, "id int, text string").repartition(3))
    kept = spark.createDataFrame(rows[:2], "id int, text string").orderBy(F.xxhash64("text").desc()).first()["text"]
    found = lambda q: {r.id for r in index.top_k(spark.createDataFrame([(0, q)], "q int, text string"), 5, "q", "text").collect()}
    assert index.state().n == 3 and index.state().length == 1 + len(kept.split())
    assert found("gamma") == ({1} if kept == "gamma" else set()) and found("beta") == ({2} if kept == "gamma" else {1, 2})
