"""The vector index: exact over all cells, reading few vectors whole; with probes, most neighbours from few cells of clustered vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import ivf, vector

FOLDERS = ["sf0.001", "sf0.01", "sf0.1"]


@pytest.mark.parametrize("sf", FOLDERS)
def test_equals_the_exact_search_and_reads_few_vectors_whole(spark, tmp_path, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    index = ivf.build(vectors, "vec_id", "embedding", f"file://{tmp_path}/index")
    got, want = (sorted((r.query_id, r["rank"], r.id) for r in x.collect()) for x in (index.top_k(queries, 10, "q", "v"), vector.top_k(vectors, queries, 10, "vec_id", "embedding", "q", "v")))
    recall = len({(q, i) for q, _, i in got} & {(q, i) for q, _, i in want}) / len(want)
    assert recall == 1.0 and got == want
    table, n = spark.read.parquet(f"file://{tmp_path}/index/cells"), vectors.count()
    made = np.array([r.centre for r in spark.read.parquet(f"file://{tmp_path}/index/centres").orderBy("cell").collect()])
    matrix = np.array([r.v for r in queries.collect()])
    whole = index.candidates(table, made, matrix, 10).select("spot").distinct().count()
    assert whole < n / 3


def test_probes_of_clustered_vectors_leave_folders_unread(spark, tmp_path):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(40, 16))
    x = middle[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(f"v{k:05d}", v.tolist()) for k, v in enumerate(x)], "id string, vector array<double>")
    queries = vectors.where("id LIKE '%00'").select(F.col("id").alias("q"), "vector")
    index = ivf.build(vectors, "id", "vector", f"file://{tmp_path}/index")
    got = {(r.query_id, r.id) for r in index.top_k(queries, 10, "q", "vector", probes=6).collect()}
    want = {(r.query_id, r.id) for r in vector.top_k(vectors, queries, 10, "id", "vector", "q", "vector").collect()}
    assert len(got & want) / len(want) >= 0.9
    table = spark.read.parquet(f"file://{tmp_path}/index/cells")
    made = np.array([r.centre for r in spark.read.parquet(f"file://{tmp_path}/index/centres").orderBy("cell").collect()])
    found = index.candidates(table, made, np.array([queries.first().vector]), 10, probes=6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    share = table.where(F.col("cell").isin([r.cell for r in found.select("cell").distinct().collect()])).count() / 4000
    assert share < 1 / 3


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.6, 0.8])]
    vectors = spark.createDataFrame(rows, "id int, vector array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "q int, v array<float>")
    index = ivf.build(vectors, "id", "vector", f"file://{tmp_path}/a", cells=2)
    assert [(r.id, r.distance) for r in index.top_k(queries, 3, "q", "v").orderBy("rank").collect()] == [(1, 0.0), (1, 0.0), (4, 0.4)]
    assert index.top_k(queries, 9, "q", "v").count() == 4 and index.top_k(queries.limit(0), 3, "q", "v").count() == 0
