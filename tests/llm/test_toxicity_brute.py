"""The toxicity classifier, from labelled rows to scores, against a plain version of its objective on a small table."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest

from weftline.llm import toxicity as tox


def plain_words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain_features(text):
    out = set()
    for word in plain_words(text):
        marked = f"^{word}$"
        out.add(marked)
        if word not in tox.NAMES:
            out |= {marked[a:b] for a in range(len(marked)) for b in range(a + 3, min(a + 5, len(marked)) + 1)}
    return out


def loss(w, b, x, y, share, moves, often):
    z = np.clip(x @ w + b, -30, 30)
    return float((share * (np.logaddexp(0, z) - y * z)).sum() + tox.RIDGE * (w**2).sum() + tox.SWAP * (often * (moves @ w) ** 2).sum())


def least(x, y, moves, often, steps=30_000):
    """The objective's least point, by gradient descent with halving steps."""
    share = np.where(y > 0.5, tox.TOXIC_ROW, 1.0)
    share /= share.sum()
    w, b, rate = np.zeros(x.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    now = loss(w, b, x, y, share, moves, often)
    for _ in range(steps):
        pull = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * share
        gw, gb = x.T @ pull + 2 * tox.RIDGE * w + 2 * tox.SWAP * moves.T @ (often * (moves @ w)), pull.sum()
        while rate > 1e-9 and (new := loss(w - rate * gw, b - rate * gb, x, y, share, moves, often)) > now:
            rate /= 2
        w, b, now, rate = w - rate * gw, b - rate * gb, min(new, now), rate * 1.5
    return w, b, now, share


def made(seed=3):
    rng = random.Random(seed)
    bad, good = ["stupid", "idiots", "hate", "filthy"], ["river", "garden", "music", "letter", "window", "market", "winter", "story"]
    rows = []
    for k in range(160):
        toxic = int(rng.random() < 0.35)
        own = rng.choices(good, k=6) + (rng.choices(bad, k=2) if toxic else []) + ([rng.choice(["women", "muslims", "frauen"])] if rng.random() < (0.8 if toxic else 0.2) else [])
        rng.shuffle(own)
        rows.append((k, " ".join(own) + rng.choice([".", "! 12", "\n_x", ""]), toxic))
    return rows


def brute_model(rows):
    own = [(plain_features(t), t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5]
    y = np.array([r[2] for r in own], float)
    rate, seen = y.mean(), {}
    for f, _, label in own:
        for x in f:
            n, bad = seen.get(x, (0, 0))
            seen[x] = (n + 1, bad + label)
    telling = {f: abs(bad - n * rate) / math.sqrt(n * rate * (1 - rate)) for f, (n, bad) in seen.items() if n >= tox.LEAST_DOCS}
    best = sorted(telling, key=lambda f: (-telling[f], f))[: tox.VOCABULARY]
    vocabulary = sorted({*best, *(f"^{w}$" for w in tox.NAMES)})
    place = {f: k for k, f in enumerate(vocabulary)}
    x = np.array([[float(f in r[0]) for f in vocabulary] for r in own])
    moves = []
    for _, text, _ in own:
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            words = re.findall(r"[^\W\d_]+", sentence)
            for name in {w for w in words if w in tox.NAMES}:
                for other in tox.LINE[name]:
                    before, after = plain_features(" ".join(words)), plain_features(" ".join(other if w == name else w for w in words))
                    row = np.zeros(len(vocabulary))
                    for f in before | after:
                        if f in place:
                            row[place[f]] = (f in after) - (f in before)
                    moves.append(row)
    return vocabulary, x, y, np.array(moves), np.full(len(moves), 1 / len(own))


def test_training_and_scores_equal_a_plain_version(spark):
    rows = made()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    vocabulary, x, y, moves, often = brute_model(rows)
    assert sorted(model.weights) == vocabulary
    _, _, lowest, share = least(x, y, moves, often, 4000)
    got = np.array([model.weights[f] for f in vocabulary])
    assert loss(got, model.bias, x, y, share, moves, often) <= 1.02 * lowest + 1e-3  # four hundred steps come that near
    scores = {r.doc_id: r.toxic_score for r in tox.score(docs, model).collect()}
    for k, text, _ in [*rows, (900, None, 0), (901, "", 0)]:
        f = plain_features(text)
        z = model.bias + sum(v for name, v in model.weights.items() if name in f)
        assert scores[k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_swaps_leave_scores_where_they_were(spark):
    rows = made(5)
    vocabulary, x, y, moves, often = brute_model(rows)
    some = moves.nonzero()
    kinds = (some[0], np.where(moves[some] < 0, ~some[1], some[1]), often)
    (fair, _), (plain, _) = tox.fit(x.astype(np.uint8), y, kinds), tox.fit(x.astype(np.uint8), y, kinds, swap=0.0)
    change = [float((often * (moves @ w) ** 2).sum()) for w in (fair, plain)]
    assert change[0] < 0.2 * change[1]
