"""Pairs that many lists of one large group share."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from weftline.llm import jaccard_join as j


@pytest.mark.parametrize("tile", [7, 256])
def test_a_pair_is_compared_in_one_list_and_tile(spark, monkeypatch, tile):
    """Twenty lists of the same rows, each without one of them; rows of even and of odd numbers are linked already but for four."""
    sets = {k: np.unique(np.arange(200, dtype=np.uint64) * np.uint64(977) + np.uint64(k * (k % 7 == 0))) for k in range(40)}
    group = {k: k % 2 if k >= 4 else k for k in sets}
    lists = [[k for k in sets if k != out] for out in range(20)]
    packed = lambda x: np.array(x, np.int64).tobytes()
    rows = spark.createDataFrame([(9 * n + 1, bytearray(packed(own)), bytearray(packed([200] * len(own)))) for n, own in enumerate(lists)], "list long, nodes binary, sizes binary")
    marks = spark.createDataFrame([(k, 200, bytearray(j.sketch(x).tobytes())) for k, x in sets.items()], "node long, n long, sketch binary")
    emitted = spark.sparkContext.accumulator(0)
    plain = j.pairs_batch

    def counted(pairs):
        emitted.add(len(pairs))
        return plain(pairs)

    monkeypatch.setattr(j, "pairs_batch", counted)
    monkeypatch.setattr(j, "TILE", tile)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # lists in several tasks
    got = [tuple(r) for r in j.apart(rows, spark.createDataFrame(list(group.items()), "node long, group long"), marks, 80).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    met = {p for own in lists for p in combinations(own, 2)}
    want = {(a, b) for a, b in met if group[a] != group[b] and j.may_link(j.sketch(sets[a]).tobytes(), j.sketch(sets[b]).tobytes(), 200, 200, 80)}
    assert set(got) == want and len(got) == len(want) == emitted.value > 100
