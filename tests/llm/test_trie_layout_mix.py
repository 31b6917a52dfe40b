"""Prefix tries, the clustered layout and the mix against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import morton_layout as ml
from weftline.llm import prefix_trie as pt
from weftline.llm import running, source_mix

CONV = "conv_id long, turn long, role string, text string"


def n_words(text):
    return len([w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])


def brute_trie(rows, family=20, shared=4):
    """Nodes by prefixes of Python tuples."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            dg = hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), dg, said))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % shared, own.get(c - int(np.fmod(c, family)), [])
        paths[c] = tuple(base[:h] + v[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for path, of in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in of if paths[c] == path)))
        kids = [p for p in members if len(p) == len(path) + 1 and p[:-1] == path]
        leaves = sum(1 for p in under if not any(len(q) == len(p) + 1 and q[:-1] == p for q in members))
        saved = sum((len(members[p]) - 1) * n_words(p[-1][1]) for p in under if p)
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows, **how):
    table = spark.createDataFrame(rows, CONV).withColumn("Digest", F.lit("x")).repartition(5)
    got = pt.trie(pt.sequences(pt.rebuilt(pt.conversations(table))), **how)
    return sorted((tuple(r)[:8] for r in got.collect()), key=str)


def some_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f", ""])))
    return rows


@pytest.mark.parametrize("turns", [1, 4, 25, 10_000])
def test_trie_equals_prefixes_however_subtries_are_split(spark, turns):
    rows = some_conversations(3)
    assert trie_rows(spark, rows, turns=turns) == brute_trie(rows)


def test_trie_of_copies_and_odd_rows(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(40, 400) for t in (0, 1, 2)]  # copies of one conversation
    rows += [(0, None, None, None), (0, 1, "user", "x y"), (0, 1, "user", "x y"), (0, 1, "a", "z"), (None, 1, "user", "lost"), (-3, 5, "user", None)]
    rows += [(7, 0, "system", "one word\n" * 30_000), (23, 0, "user", "alone")]
    assert trie_rows(spark, rows, turns=30) == brute_trie(rows)


def test_trie_of_turnless_conversations_and_of_none(spark):
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(turnless, 0, "user", "gone")]
    assert trie_rows(spark, rows) == brute_trie(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert trie_rows(spark, []) == [] == trie_rows(spark, [(None, 0, "user", "x")])


def test_trie_turns_name_their_texts(spark):
    table = spark.createDataFrame([(20, 0, "user", "hi"), (20, 1, None, "yes")], CONV)
    nodes = pt.trie(pt.sequences(pt.conversations(table)))
    got = nodes.join(pt.turn_texts(table), "turn", "left").orderBy("depth").select("depth", "role", "text").collect()
    assert [tuple(r) for r in got] == [(0, None, None), (1, "user", "hi"), (2, "", "yes")]


# ---------------------------------------------------------------- layout


def test_ranges_cover_boxes_exactly_by_jumps():
    rng = np.random.default_rng(5)
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        corners = np.sort(rng.integers(0, 1 << bits, (60, dims, 2)), axis=2)
        low, high = (ml.interleaved(list(corners[:, :, k].T), bits) for k in (0, 1))
        found, last = defaultdict(list), {}
        for own, a, b in ml.ranges(low, high, dims, bits):
            for k, x, y in zip(own.tolist(), a.tolist(), b.tolist(), strict=True):
                assert x > last.get(k, -1)
                last[k] = y
                found[k] += range(x, y + 1)
        points = np.array(list(product(range(1 << bits), repeat=dims)))
        z = ml.interleaved(list(points.T), bits)
        for k in range(60):
            inside = ((points >= corners[k, :, 0]) & (points <= corners[k, :, 1])).all(axis=1)
            assert sorted(z[inside].tolist()) == found[k]
            for at in rng.integers(0, 1 << dims * bits, 20):
                more = z[inside & (z >= at)]
                assert ml.next_inside(np.array([at]), low[k : k + 1], high[k : k + 1], dims, bits)[0] == (more.min() if len(more) else -1)


def brute_layout(docs, rows):
    def values(d):
        return [(d[1] is not None, (d[1] or "").encode()), (d[2] is not None, (d[2] or "").encode()), -1 if d[3] is None else len(d[3].encode()), -1 if d[0] is None else zlib.crc32(str(d[0]).encode()) % 365]

    v = [values(d) for d in docs]
    coords = [[16 * sum(y[k] < x[k] for y in v) // len(v) for k in range(4)] for x in v]
    code = lambda c: sum((c[k] >> b & 1) << (4 * b + 3 - i) for i, k in enumerate((2, 0, 3, 1)) for b in range(4))
    order = sorted(range(len(docs)), key=lambda i: (code(coords[i]), docs[i][0] is not None, docs[i][0] or 0))
    file = {i: p // rows for p, i in enumerate(order)}
    bounds = {f: [(min(coords[i][k] for i in order if file[i] == f), max(coords[i][k] for i in order if file[i] == f)) for k in range(4)] for f in set(file.values())}
    out = []
    for p, i in enumerate(order):
        box = [(c - r, c + r) for c, r in zip(coords[i], (0, 0, 2, 2), strict=True)]
        touched = sum(all(a <= y and b >= x for (a, b), (x, y) in zip(bounds[f], box, strict=True)) for f in bounds)
        matching = len({file[j] for j in order if all(x <= coords[j][k] <= y for k, (x, y) in enumerate(box))})
        out.append((docs[i][0], code(coords[i]), p, file[i], touched, matching, ",".join(f"{a},{b}" for a, b in bounds[file[i]])))
    return out


def laid_out(spark, docs, rows):
    table = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").selectExpr("*", "'x' AS part", "1 AS before_n", "'y' AS Z").repartition(6)
    placed = ml.S.cut(ml.layout(table, rows=rows), "placed")
    assert {"part", "before_n"} <= set(placed.columns)
    bounds = ml.file_bounds(placed)
    shown = F.concat_ws(",", *(F.col(f"{w}_{n}").cast("string") for n in ml.SHOWN for w in ("min", "max")))
    met = placed.join(ml.answers(placed, bounds).drop("first_file"), "z").join(bounds.select("file", shown.alias("b")), "file")
    return [tuple(r) for r in met.orderBy("position").select("doc_id", "z", "position", "file", "files_touched", "files_matching", "b").collect()]


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_layout_and_queries_equal_brute_force(spark, rows):
    rng = random.Random(rows)
    docs = [(i, rng.choice(["src1", "src2", "Ü", None]), rng.choice(["en", "de", None]), rng.choice([None, "", "ä" * rng.randint(0, 40)])) for i in range(120)]
    assert laid_out(spark, docs, rows) == brute_layout(docs, rows)


def test_layout_of_equal_rows_odd_rows_and_none(spark):
    docs = [(5, "s", "en", "x")] * 40 + [(None, None, None, None), (6, "s", "en", "long " * 50_000)]
    assert laid_out(spark, docs, 9) == brute_layout(docs, 9)
    assert laid_out(spark, [], 9) == []


def test_saved_layout_gives_a_box_by_pushed_ranges(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('s', id % 7) AS source", "concat('l', id % 3) AS lang", "repeat('x', int(id % 90)) AS text")
    placed = ml.layout(docs)
    ml.save(placed, f"file://{tmp_path}/placed")
    table = spark.read.parquet(f"file://{tmp_path}/placed")
    box = {"source": (2, 6), "length": (3, 9)}
    got = ml.select(table, box)
    assert "z" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    want = table.where("c_source BETWEEN 2 AND 6 AND c_length BETWEEN 3 AND 9")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect()) != []


# ---------------------------------------------------------------- running sums and the mix


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 9]), rng.randint(0, 5)) for _ in range(300)]
    table = running.ordered(spark.createDataFrame(rows, "k long, x long").repartition(7), [F.col("k")], "test")
    got = running.summed(table, {"before": "x"}).join(running.placed(table, "p").groupBy("k").agg(F.min("p").alias("p")), "k").collect()
    smaller = {k: sum(x for j, x in rows if j < k) for k in (1, 2, 9)}
    assert len(got) == 300 and {k: min(r.before for r in got if r.k == k) for k in smaller} == smaller
    assert {r.k: r.p for r in got} == {k: sum(j < k for j, _ in rows) for k in smaller}
    last = max(got, key=lambda r: (r.before, r.x))
    assert last.before + last.x == sum(x for _, x in rows)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Clamp and share again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while free := [s for s in names if s not in fixed]:
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] >= epochs * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: epochs * sizes[s] for s in above}
    return fixed


def mixed(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 AS Target", "2 AS key", "3 AS before").repartition(5)
    return source_mix.mix(table).collect()


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None, "Ä"]), "w " * rng.randint(0, 30)) for i in range(600)]
    got = mixed(spark, docs)
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += n_words(t)
    goals = brute_targets(sizes)
    assert len(got) == 600 and {r.source: r.source_size for r in got} == sizes
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(goals[s]) and abs(sum(r.taken for r in own) - goals[s]) <= 15
        assert len({r.taken // r.size for r in own if r.size}) <= 2
    assert all(r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0 and r.key == 2 and r.before == 3 for r in got)
    assert sorted((r.doc_id, r.taken) for r in mixed(spark, docs)) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_of_odd_rows(spark):
    docs = [(1, "a", "x y"), (1, "a", "x y"), (None, None, None), (2, "none", ""), (3, "long", "z " * 200_000), (4, "a", None)]
    got = mixed(spark, docs)
    goals = brute_targets({"a": 4, "long": 200_000, "none": 0, None: 0})
    assert {r.source: r.target for r in got} == pytest.approx(goals) and all(r.taken <= 2 * r.size for r in got)
    assert mixed(spark, []) == []
    assert [(r.target, r.taken) for r in mixed(spark, [(1, "a", ""), (2, "b", None)])] == [(0.0, 0)] * 2
