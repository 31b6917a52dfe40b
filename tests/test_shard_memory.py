"""What is held while shards are made, and shared terms by shards."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import blockmax, bm25


def test_a_piece_holds_postings_of_wanted_tokens_alone():
    rng = random.Random(2)
    lists = pa.array([[f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(400)] for _ in range(500)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), lists], ["id", "tokens"])
    piece = blockmax._piece(batch, 1000, pa.array(["w1", "w77", "nowhere"]))
    assert piece[1].tolist() == [400] * 500 and sorted(piece[2].to_pylist()) == ["w1", "w77"]
    got = {(piece[2][t].as_py(), d - 1000): n for t, d, n in zip(*(x.tolist() for x in piece[3:]), strict=True)}
    assert got == {(w, d): own.count(w) for d, own in enumerate(lists.to_pylist()) for w in ("w1", "w77") if w in own}
    assert sum(x.nbytes for x in piece[1:]) < lists.nbytes / 50


def test_shared_terms_by_shards_equal_counts(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 300:03d}" for _ in range(n))
    docs = spark.createDataFrame([(k, say(rng.randint(0, 60))) for k in range(700)] + [(9000, None), (9001, "w001")], "id int, text string").repartition(3)
    queries = spark.createDataFrame([(k, say(rng.randint(1, 20))) for k in range(30)] + [(90, "nowhere"), (91, None)], "q int, text string")
    wanted = bm25.query_terms(queries, "q", "text").cache()
    has = docs.select("id", F.explode(F.array_distinct(tx.terms("text"))).alias("token"))
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    met = has.join(wanted, "token").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("both"))
    want = bm25.ranked(met.join(size, "query_id").select("query_id", "id", F.round(F.col("both") / F.col("n"), 6).alias("score")), 7)
    got = bm25.shared(bm25.searchable(docs, wanted, "id", "text"), wanted, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_frequencies_count_documents_without_a_shuffle_of_postings(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb"), (2, "bb"), (3, None)], "id int, text string")
    tokens = bm25.build(docs, "id", "text").tokens
    assert {r.token: r.df for r in tokens.collect()} == {"aa": 1, "bb": 3}
    assert tokens._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
