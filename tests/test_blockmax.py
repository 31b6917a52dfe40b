"""Block-max search against scores of every document, and what it leaves unscored."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions.text import terms
from weftline.operators import blockmax, bm25


def brute(docs, queries, k, k1=1.5, b=0.75):
    own = {i: Counter(t.split()) for i, t in docs}
    size = {i: sum(c.values()) for i, c in own.items()}
    n, avg = len(docs), sum(size.values()) / len(docs)
    df = Counter(t for c in own.values() for t in c)
    out = set()
    for q, text in queries:
        score = {}
        for i, c in own.items():
            got = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] / (c[t] + k1 * (1 - b + b * size[i] / avg)) for t in set(text.split()) if t in c]
            if got:
                score[i] = round(sum(got), 6)
        out |= {(q, i, r + 1, -s) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


def zipf(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % 500:03d}" for _ in range(n))


@pytest.mark.parametrize("docs_each", [7, 100_000])
def test_block_max_equals_all_scores(spark, docs_each):
    rng = random.Random(docs_each)
    docs = [(f"d{k:04d}", zipf(rng, rng.randint(0, 80))) for k in range(900)]
    docs += [(f"e{k}", docs[5][1]) for k in range(30)]  # ties
    queries = [(k, zipf(rng, rng.randint(1, 25))) for k in range(40)] + [(90, "nowhere"), (91, ""), (92, docs[5][1])]
    table = spark.createDataFrame(docs, "id string, text string").repartition(3)
    wanted = bm25.query_terms(spark.createDataFrame(queries, "q int, text string"), "q", "text")
    shards = blockmax.shards(table, "id", terms("text"), docs_each=docs_each).cache()
    for k in (1, 10):
        got = bm25.ranked(blockmax.top_k(blockmax.Index.of(shards), wanted, k, bm25.K1, bm25.B), k)
        rows = {(r.query_id, r.id, r.rank) for r in got.collect()}
        assert rows == {x[:3] for x in brute(docs, queries, k)}
    stats = {r.token: r.df for r in blockmax.tokens(shards).collect()}
    assert stats == Counter(t for _, d in docs for t in set(d.split()))
    n, avg = blockmax.corpus(shards).first()
    assert n == len(docs) and avg == pytest.approx(sum(len(d.split()) for _, d in docs) / len(docs))


def test_most_postings_are_never_scored(spark):
    rng = random.Random(3)
    docs = [(k, " ".join([*zipf(rng, 60).split(), *(f"r{rng.randint(0, 3000)}" for _ in range(20))])) for k in range(4000)]
    queries = [(k, " ".join([*docs[k * 37][1].split()[:15], *docs[k * 37][1].split()[-10:]])) for k in range(40)]
    table = spark.createDataFrame(docs, "id int, text string").coalesce(1)
    shards = blockmax.shards(table, "id", terms("text")).toArrow()
    head, postings = shards.filter(pa.compute.is_null(shards["token"])), shards.filter(pa.compute.is_valid(shards["token"]))
    shard = blockmax.Shard.of(postings, head.rename_columns(["of_ids" if c == "ids" else "of_lengths" if c == "lengths" else c for c in head.column_names]), bm25.K1, bm25.B, 80.0)
    df = {t: len(d) for t, d in zip(postings["token"].to_pylist(), postings["docs"].to_pylist(), strict=True)}
    for _, text in queries:
        found, score = shard.search([(t, math.log(1 + (4000 - df[t] + 0.5) / (df[t] + 0.5))) for t in set(text.split())], 10, -math.inf)
        assert len(found) >= 10 and score.max() > 20
    assert shard.scored < 0.3 * shard.met


def test_odd_rows_and_filters(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "alpha beta", "b"), (4, "alpha alpha beta", "a"), (None, "alpha", "b")], "id int, text string, kind string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "gamma")], "q int, text string")
    got = lambda **how: [(r.query_id, r.id) for r in bm25.top_k(docs, queries, 5, "id", "text", "q", "text", **how).orderBy("query_id", "rank").collect()]
    assert got() == [(1, 3), (1, 4), (1, None)] and got(where={"kind": "a"}) == [(1, 4)] == got(where={"kind": "a"}, mode="exact")
    assert bm25.top_k(docs.limit(0), queries, 5, "id", "text", "q", "text").count() == 0 == bm25.top_k(docs, queries.limit(0), 5, "id", "text", "q", "text").count()


def test_an_index_of_postings_gives_the_same(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, zipf(rng, 30)) for k in range(300)], "id int, text string")
    queries = spark.createDataFrame([(k, zipf(rng, 6)) for k in range(20)], "q int, text string")
    one, two = (bm25.top_k(docs, queries, 7, "id", "text", "q", "text", index=x) for x in (None, bm25.build(docs, "id", "text")))
    assert {tuple(r) for r in one.withColumn("distance", F.round("distance", 5)).collect()} == {tuple(r) for r in two.withColumn("distance", F.round("distance", 5)).collect()}
