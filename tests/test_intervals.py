"""Interval joins against all pairs, and how many pairs they form."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.intervals import binned, overlap_join


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_overlaps_equal_all_pairs_once_each(spark, width):
    rng = random.Random(width)
    side = lambda n: [(k, rng.choice(["a", "b", None]), s := rng.randint(0, 300), s + rng.randint(-3, 90)) for k in range(n)]
    left, right = side(80), side(90)
    frame = lambda rows, p: spark.createDataFrame(rows, f"{p} int, key string, {p}s long, {p}e long")
    got = [(r.l, r.r) for r in overlap_join(frame(left, "l"), frame(right, "r"), "key", ("ls", "le"), ("rs", "re"), width).collect()]
    want = {(a[0], b[0]) for a in left for b in right if a[1] and a[1] == b[1] and max(a[2], b[2]) < min(a[3], b[3])}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_long_document_forms_no_product(spark):
    chunks = spark.range(100_000).select(F.lit("d").alias("key"), F.col("id").alias("chunk"), (F.col("id") * 900).alias("cs"), (F.col("id") * 900 + 1000).alias("ce"))
    spans = spark.range(10_000).select(F.lit("d").alias("key"), F.col("id").alias("span"), (F.col("id") * 9000 + 50).alias("s"), (F.col("id") * 9000 + 950).alias("e"))
    pairs = binned(spans, "s", "e", "bin").join(binned(chunks, "cs", "ce", "bin"), ["key", "bin"]).count()
    assert pairs < 10 * 10_000
    assert overlap_join(spans, chunks, "key", ("s", "e"), ("cs", "ce")).count() == 29_999  # three chunks each, but for the first
