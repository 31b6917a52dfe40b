"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code is a binary classifier over byte-class trigrams that tells the
languages with a 1 there from those with a 0. A text's bits are decoded by loss: the language whose codeword loses least,
each bit weighted by how well its two sides separate. Two codewords that lose nearly alike make the text ambiguous.

Defined results: `und` with score 0 and not ambiguous for a null text or one without a letter, and for every text if no
labelled row was there to learn from; null languages are never learned; repeated rows each give a row; a very long text is
judged whole, WINDOW places at a time; other columns pass through `identify` with carry, whatever their names, but for
those named like its results, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Labelled rows to learn from, about, at most: a documented bound; each language has an equal part of it, and they are chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Evidence of so many trigrams counts at most, and the loss difference under which a text is ambiguous.
FULL_EVIDENCE, AMBIGUOUS = 60.0, 0.05
SMOOTHING = 0.5
#: Positions that are looked up at once.
WINDOW = 1 << 20
BINS = 1 << 18


def byte_classes() -> np.ndarray:
    """Letters without case 1 to 26, bytes of other scripts 32 to 63 by their low bits, all else 0."""
    out = np.zeros(256, np.int32)
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = k + 1
    out[128:] = 32 + (np.arange(128) & 31)
    return out


CLASSES = byte_classes()


def codewords(n: int) -> np.ndarray:
    """n rows of bits: every split of the languages in two for few, pseudo-random ones of 15 bits and more for many."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[(c >> k) & 1 for c in range(1 << (n - 1), (1 << n) - 1)] for k in reversed(range(n))], np.int8)
    bits = max(15, 6 * int(np.ceil(np.log2(n))))
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits)).astype(np.int8)
        if (code.min(0) == code.max(0)).any():
            continue
        least = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weight: np.ndarray  # bits
    table: np.ndarray  # trigrams x bits


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigram at each place of all texts, and each text's number of them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string()) if pa.types.is_string(texts.type) else pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    cls = CLASSES[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    sizes = np.diff(offsets)
    if len(cls) < 3:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    at = (cls[:-2] << 12) | (cls[1:-1] << 6) | cls[2:]
    good = np.ones(len(cls), bool)
    ends = offsets[1:] - offsets[0]
    for back in (1, 2):  # places whose trigram would reach into the next text
        last = ends - back
        good[last[(last >= 0) & (sizes >= back)]] = False
    counts = np.maximum(sizes - 2, 0)
    return at[good[:-2]], counts


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """About rows of docs at most, as many of each language as of others (all of a rarer one), by a hash of doc_id: the same ones wherever they lie."""
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row a language
    each = rows / max(1, found.count())
    share = found.select("lang", F.least(F.lit(1 << 30), (F.lit(each * (1 << 30)) / F.col("n"))).cast("long").alias("below"))
    return docs.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("below"))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows with a language outside the held-out fold. Trigram counts are summed by language before they come to the driver: at most BINS rows of each."""
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(S.crc_of_id(), F.lit(3)) != 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in S.blocks(batches, "text", 4 << 20):
            at, n = trigrams(block.column("text"))
            code = block.column("lang").dictionary_encode()
            both = np.repeat(code.indices.to_numpy(zero_copy_only=False).astype(np.int64), n) * BINS + at
            key, times = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(key // BINS)), pa.array((key % BINS).astype(np.int32)), pa.array(times.astype(np.int64))], ["lang", "bin", "n"])

    met = sample(labelled, rows).select("lang", "text").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    code = met["lang"].combine_chunks().dictionary_encode() if met.num_rows else pa.array([], pa.string()).dictionary_encode()
    if isinstance(code, pa.ChunkedArray):
        code = code.combine_chunks()
    of, bins, n = code.indices.to_numpy(zero_copy_only=False), met["bin"].to_numpy(), met["n"].to_numpy()
    total = {lang: np.bincount(bins[of == k], weights=n[of == k], minlength=BINS) for k, lang in enumerate(code.dictionary.to_pylist())}
    S.release()
    languages = sorted(total)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), np.zeros((BINS, 0), np.float32))
    shares = np.array([(total[x] + SMOOTHING) / (total[x].sum() + SMOOTHING * BINS) for x in languages])
    code = codewords(len(languages))
    sides = [(shares[code[:, b] == 1].mean(0), shares[code[:, b] == 0].mean(0) if (code[:, b] == 0).any() else shares.mean(0)) for b in range(code.shape[1])]
    apart = np.array([0.5 * ((p - q) * (np.log(p) - np.log(q))).sum() for p, q in sides])
    table = np.stack([np.log(p) - np.log(q) for p, q in sides], 1).astype(np.float32)
    return Model(languages, code * 2.0 - 1, apart / max(apart.mean(), 1e-9), table)


def margins(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mean evidence for each bit, and the number of trigrams, of each text."""
    at, n = trigrams(texts)
    out = np.zeros((len(n), model.table.shape[1]))
    ends = np.cumsum(n)
    for a in range(0, len(at), WINDOW):
        b = min(len(at), a + WINDOW)
        first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b - 1, side="right")
        rows = np.arange(first, last + 1)
        rows = rows[n[rows] > 0]
        starts = np.maximum(ends[rows] - n[rows], a) - a
        out[rows] += np.add.reduceat(model.table[at[a:b]], starts, axis=0)
    return out / np.maximum(n, 1)[:, None], n


def decode(model: Model, evidence: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the language that loses least, its share of all, and whether the next one is as near."""
    sure = evidence * np.minimum(n, FULL_EVIDENCE)[:, None]
    loss = (model.weight * np.logaddexp(0, -sure[:, None, :] * model.code[None])).sum(2)
    best = loss.argmin(1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    order = np.sort(loss, 1)
    return best, 1 / share.sum(1), (order[:, 1] - order[:, 0] < AMBIGUOUS) if loss.shape[1] > 1 else np.zeros(len(best), bool)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """lang_pred, lang_score and lang_ambiguous of every text: with the id, or with carry beside all columns of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "lang_score", "lang_ambiguous"]
    kept = S.others(docs, *names) if carry else [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for block in S.blocks(batches, "text", 4 << 20):
            texts = block.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False) & bool(model.languages)
            pred, score, near = np.array(["und"] * len(letters), object), np.zeros(len(letters)), np.zeros(len(letters), bool)
            if letters.any():
                best, share, close = decode(model, *margins(model, texts))
                pred[letters], score[letters], near[letters] = np.array(model.languages, object)[best[letters]], share[letters], close[letters]
            yield pa.RecordBatch.from_arrays([*(block.column(k) for k in range(len(kept))), pa.array(pred, pa.string()), pa.array(score), pa.array(near)], [*kept, *names])

    own = docs.select(*(S.quoted(c).alias(f"kept_{k}") for k, c in enumerate(kept)), S.quoted(text_col).alias("text"))
    return own.mapInArrow(run, S.fields(docs, kept, "lang_pred string, lang_score double, lang_ambiguous boolean"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = S.documents(spark, sf_dir)
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(F.pmod(S.crc_of_id(), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
