"""Very long texts: the same results as by brute force, in time that grows about as the text does."""

from __future__ import annotations

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality_ledger, secret_markov

BASE62 = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def table(spark):
    return secret_markov.train(secret_markov.labelled_samples(spark))


def test_folds_before_each_place(spark):
    rng = random.Random(4)
    for n in (0, 1, 127, 128, 129, 1000):
        xs = [rng.randint(0, 99) for _ in range(n)]
        row = spark.createDataFrame([(xs,)], "xs array<int>").select(secret_markov.scanned(F.col("xs"), lambda a, x: a + x).alias("s"), secret_markov.scanned(F.col("xs"), F.greatest).alias("m")).first()
        assert row.s == [sum(xs[:k]) for k in range(n)] and row.m == [max([0, *xs[:k]]) for k in range(n)]


def test_a_run_of_a_million_characters(spark, table):
    rng = random.Random(6)
    run = "".join(rng.choices(BASE62, k=1_000_000))
    docs = spark.createDataFrame([(f"a {run} b", 0)], "text string, k int")
    began = time.time()
    spans = secret_markov.scan(docs, table).first()["spans"]
    masked = secret_markov.masked(docs, table).first()["text"]
    assert [tuple(s) for s in spans] == [(2, 3, 1_000_002)] and masked == "a [SECRET] b"
    assert time.time() - began < 40  # two passes


def test_a_hundred_thousand_spans(spark, table):
    rng = random.Random(7)
    parts = [f"{'é😀'[k % 2]} {rng.choice(['password=', 'token: ', 'api_key = '])}{''.join(rng.choices(BASE62, k=rng.randint(8, 20)))}\n" for k in range(100_000)]
    text = "".join(parts)
    docs = spark.createDataFrame([(text,)], "text string")
    began = time.time()
    spans = secret_markov.scan(docs, table).first()["spans"]
    taken = time.time() - began
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:password|token|api_key)\x20*[:=]\x20*[A-Za-z0-9]+""", text)]
    assert [tuple(s) for s in spans] == found and len(found) == 100_000 and taken < 20
    began = time.time()
    masked = secret_markov.masked(docs, table).first()["text"]
    assert masked == "".join(f"{'é😀'[k % 2]} [SECRET]\n" for k in range(100_000)) and time.time() - began < 40


def test_masks_of_overlapping_spans(spark, table):
    hexes = "0123456789abcdef" * 3
    rows = [(1, f"x token={hexes}.zz AKIA{'B' * 16} {hexes}{'é' * 300}{hexes}"), (2, f"{hexes}"), (3, f"{hexes} {hexes}")]
    got = dict(secret_markov.masked(spark.createDataFrame(rows, "id int, text string"), table).select("id", "text").collect())
    assert got == {1: f"x [SECRET] [SECRET] [SECRET]{'é' * 300}[SECRET]", 2: "[SECRET]", 3: "[SECRET] [SECRET]"}


def test_quality_of_a_text_of_millions_of_words(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(400_000)]
    text = " ".join(words + words[:5] + ["end"])
    docs = spark.createDataFrame([(1, text), (2, "a b c " * 500_000)], "doc_id int, text string")
    got = {r.doc_id: r for r in quality_ledger.measured(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words) == (400_006, 10)
    assert (got[2].n_words, got[2].n_repeat_words, got[2].word_chars) == (1_500_000, 1_500_000, 1_500_000)


def test_totals_while_another_writer_compacts(spark, tmp_path):
    """totals() with a compaction in between, after each of the steps in which it looks at files."""
    from weftline.llm.token_rollup import SCHEMA, Rollup

    class Interleaved(Rollup):
        def __init__(self, *args, after):
            super().__init__(*args)
            self.steps, self.after = 0, after

        def _step(self):
            self.steps += 1
            if self.steps == self.after:
                assert Rollup(self.spark, self.path).compact()

        def _names(self, folder):
            out = super()._names(folder)
            self._step()
            return out

        def _read(self, name):
            out = super()._read(name)
            self._step()
            return out

    row = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], SCHEMA)
    after, met = 1, True
    while met:
        path = f"file://{tmp_path}/r{after}"
        first = Rollup(spark, path)
        assert first.commit("a", row(3)) and first.compact() and first.commit("b", row(4)) and first.commit("c", row(5))
        reader = Interleaved(spark, path, after=after)
        assert [tuple(r)[3:] for r in reader.totals().collect()] == [(3, 12)]
        met = reader.steps >= after
        if met:
            assert not first.commit("b", row(4)) and first.batches() == ["a", "b", "c"] and first._names("batches") == []
            with pytest.raises(ValueError):
                first.commit("c", row(4))
        after += 1
    assert after > 5
