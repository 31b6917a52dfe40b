"""What counting and scoring of features hold at once."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from weftline.llm import toxicity


def test_repeated_words_take_no_room():
    """A text's words are looked up once each: memory goes with the distinct ones."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(3000)]
    texts = pa.array([" ".join(rng.choices(words, k=40_000)) for _ in range(4)] + [None, "", words[0]])
    place = {f: k for k, f in enumerate(sorted({f for w in words for f in toxicity.features(w)}))}
    lookup = toxicity.Lookup(place)
    for w in words:
        lookup(w)
    tracemalloc.start()
    row, at = toxicity._pairs(texts, lookup)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    want = [(k, f) for k, t in enumerate(texts.to_pylist()) for f in sorted({f for w in set((t or "").split()) for f in lookup(w)})]
    assert np.stack([row, at], 1).tolist() == [list(x) for x in want]
