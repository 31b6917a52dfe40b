"""Needles by rare grams against a scan of every text."""

from __future__ import annotations

import random

import pytest

from weftline.operators import anchors, labels


def places(texts, needles, first):
    out = []
    for key, text in texts:
        for n, needle in needles:
            at = (text or "").find(needle or "") if needle and len(needle) >= anchors.SHORTEST else -1
            while at >= 0:
                out.append((n, key, at, at + len(needle)))
                at = -1 if first else text.find(needle, at + 1)
    return sorted(out, key=repr)


@pytest.mark.parametrize("first", [False, True])
def test_places_equal_a_scan(spark, first):
    rng = random.Random(first)
    word = lambda: "".join(rng.choices("abé😀 ", k=rng.randint(1, 9)))
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 120)))) for k in range(60)]
    texts += [(3, texts[5][1]), (3, texts[5][1]), (None, texts[6][1]), (70, None), (71, ""), (72, "a" * 500), (73, "x" * 10 + "Zq" * 200)]
    needles = [(f"n{k}", t[1][at : at + rng.randint(20, 80)]) for k in range(150) if len((t := rng.choice(texts[:60]))[1]) > 30 for at in [rng.randint(0, len(t[1]) - 20)]]
    needles += [("same", "a" * 40), ("zq", "qZ" * 20), ("gone", "not there at all in any of these texts"), ("twice", needles[0][1]), ("null", None), ("empty", ""), (None, needles[1][1])]
    docs, asked = spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame(needles, "n string, s string")
    got = sorted((tuple(r) for r in anchors.find_spans(docs, asked, "id", "text", "n", "s", first).collect()), key=repr)
    assert got == places(texts, needles, first) and len(got) > 100


def test_many_needles_in_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(k, "".join(rng.choices("abcdefgh \n", k=60_000))) for k in range(10)]
    needles = [(k, texts[k % 10][1][at : at + 50]) for k in range(20_000) for at in [rng.randint(0, 59_000)]] + [(99_999, "abc")]
    docs, asked = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(needles, "n int, s string")
    monkeypatch.setattr(labels, "NEEDLE_CHARS", 1000)
    got = labels.find_spans(docs, asked.where("n <> 99999"), "id", "text", "n", "s")
    rows = {tuple(r) for r in got.collect()}
    assert len(rows) == 20_000 and all(texts[i][1][a:b] == needles[n][1] for n, i, a, b in rows)
    short = {tuple(r) for r in labels.find_spans(docs, asked.where("n > 19990"), "id", "text", "n", "s").collect()}
    assert {r for r in short if r[0] < 99_999} == {r for r in rows if r[0] > 19_990} and sum(r[0] == 99_999 for r in short) == sum(t.count("abc") for _, t in texts)


def test_marks_of_a_needle_are_marks_of_its_texts():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choices("abc é", k=300))
        at, size = rng.randint(0, 200), rng.randint(anchors.SHORTEST, 90)
        own, of = anchors.marks(text), anchors.marks(text[at : at + size])
        assert len(of[0]) and {(p + at, h) for p, h in zip(*(x.tolist() for x in of), strict=True)} <= set(zip(*(x.tolist() for x in own), strict=True))
