"""Toxicity by a counterfactually regularised linear classifier.

A logistic model over the distinct words of a text and the three to five letter stretches inside them. Every sentence of
the labelled sample that names a group is written anew with each other name of the group's line in its place; the squared
difference of the two sentences' scores, over all features in which they differ, is part of the loss. So neutral mentions
of a group move no text towards either label. Group names have no stretches, else these could carry a bias into other
words. The vocabulary is the words that tell the labels apart best, with all group names.

Defined results: an empty or null text has the score of a text without known words; null labels are not learned; a
document with several labels counts as toxic if one of them says so; rows of equal id and text are learned once; without
labelled rows every score is 0.5 less a hair and nothing is predicted toxic; repeated rows each give a row; a very long
text is scored whole, in a block of its own; other columns pass through `score` with carry, whatever their names, but for
one named like its own result, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Labelled rows to learn from, at most about; features of the vocabulary; least number of sample documents with a feature.
TRAIN_ROWS, VOCABULARY, LEAST_DOCS = 20_000, 2048, 8
#: Weight of a toxic row, of squared weights, of squared score changes under swaps, steps of the descent, and rows that are made floats at once.
TOXIC_ROW, RIDGE, SWAP, STEPS, ROWS = 2.0, 1e-4, 10.0, 400, 1024
#: Pairs of a text and a feature that are sorted at once, about; a longer text has its own together.
PAIRS = 500_000
#: Bytes of text whose features, all of them, are counted at once, and whose places in the vocabulary are looked up at once.
COUNTED, SCORED = 1 << 19, 1 << 20
#: Words whose features a Python worker keeps, and the characters of the longest such word.
MEMO_WORDS, MEMO_CHARACTERS = 200_000, 100
#: Fixed group names in four languages; those of one line are swapped for each other.
GROUPS = [
    "women men girls boys woman man girl boy",
    "christians muslims jews hindus buddhists atheists christian muslim jewish hindu buddhist atheist",
    "black white asian latino african european arab american",
    "gay straight lesbian bisexual transgender",
    "immigrants refugees foreigners locals citizens",
    "old young elderly disabled deaf blind",
    "femmes hommes filles garçons chrétiens musulmans juifs noirs blancs immigrés étrangers réfugiés",
    "frauen männer mädchen jungen christen muslime juden schwarze weiße ausländer flüchtlinge einwanderer",
    "mujeres hombres niñas niños cristianos musulmanes judíos negros blancos inmigrantes extranjeros refugiados",
]
NAMES = frozenset(w for line in GROUPS for w in line.split())
LINE = {name: [w for line in GROUPS if name in line.split() for w in line.split() if w != name] for name in NAMES}
_NAMED, _ENDS, _WORD = re.compile("|".join(map(re.escape, sorted(NAMES))), re.I), re.compile(r"[.!?\n]+"), re.compile(r"[^\W\d_]+")
#: ASCII characters that are no letters part words, as do characters beyond ASCII that are no letters, marks, numbers or joiners.
_BEYOND = r"[^\x00-\x7F\p{L}\p{M}\p{N}\p{Cf}]"
_APART = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For every word its text and its place in the list of distinct lower-case words."""
    lower = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), _BEYOND, " ")
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = lower.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    flat = _APART[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]]
    plain = pa.LargeStringArray.from_buffers(len(lower), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(flat.tobytes()))
    lists = pc.utf8_split_whitespace(plain)
    coded = lists.flatten().dictionary_encode()
    row, index, distinct = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    if "" in distinct:  # what stands before a text's first word or after its last is none
        some = index != distinct.index("")
        row, index = row[some], index[some]
    return row, index, distinct


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


def features(word: str) -> Iterator[str]:
    """The word itself, and its three to five character stretches with marks for its edges; a group name has no stretches."""
    marked = f"^{word}$"
    yield marked
    if word not in NAMES:
        yield from (marked[k : k + n] for n in (3, 4, 5) for k in range(len(marked) - n + 1))


class Lookup:
    """Places in the vocabulary of a word's features, kept for words seen before."""

    def __init__(self, place: dict[str, int]):
        self.place, self.memo = place, {}

    def __call__(self, word: str) -> list[int]:
        if (got := self.memo.get(word)) is None:
            got = list({k for f in features(word) if (k := self.place.get(f)) is not None})
            if len(word) <= MEMO_CHARACTERS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = got
        return got


def _pairs(texts: pa.Array, lookup) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a text and a feature in it, each once; lookup gives the features' numbers of a word."""
    row, index, distinct = words(texts)
    once = np.unique(row * max(1, len(distinct)) + index)  # a text's distinct words: what follows is many times as large
    row, index = np.divmod(once, max(1, len(distinct)))
    lists = [lookup(w) for w in distinct]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((k for x in lists for k in x), np.int64, int(n.sum()))
    has = n[index] > 0 if len(index) else np.zeros(0, bool)
    row, index = row[has], index[has]
    width = int(flat.max()) + 1 if len(flat) else 1
    starts, counts = S.excl(n)[index], n[index]
    # by texts of about PAIRS pairs together, so that only one part is sorted at a time
    ends = np.cumsum(counts)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    begun = ends[first] - counts[first]
    cuts = [*first[np.flatnonzero(np.diff(begun // PAIRS, prepend=-1))].tolist(), len(row)]
    parts = [np.unique(np.repeat(row[a:b], counts[a:b]) * width + S.ragged(flat, starts[a:b], counts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    pairs = np.concatenate([np.zeros(0, np.int64), *parts])
    return np.divmod(pairs, width)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of labelled documents outside the held-out fold, each id and text once: about rows at most, by hashes of ids and then of texts."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(S.crc_of_id(), F.lit(5)) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    within = lambda *key: lambda n: F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(1 << 30)) < int(rows / n * (1 << 30))
    n = own.count()
    if n > rows:
        own = own.where(within("doc_id")(n))
    # ids and labels of about `rows` rows at most are broadcast
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(own), "doc_id")
    met = S.cut(found.repartition(16, "doc_id", "text").dropDuplicates(["doc_id", "text"]).select("text", F.col("toxic").cast("int").alias("toxic")), "toxic")
    n = met.count()  # ids may have had many texts
    return met if n <= 2 * rows else met.where(within("text")(n))


def swaps(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """The words of each sentence that names a group, and those of the sentence with another name in its place."""
    for sentence in _ENDS.split(text.lower()):
        own = _WORD.findall(sentence)
        for name in NAMES.intersection(own):
            for other in LINE[name]:
                yield own, [other if w == name else w for w in own]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = labelled(docs, labels, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in S.blocks(batches, "text", COUNTED):
            seen: dict[str, int] = {}
            row, at = _pairs(block.column("text"), lambda w: list({seen.setdefault(f, len(seen)) for f in features(w)}))
            toxic = block.column("toxic").to_numpy()
            n, bad = np.bincount(at, minlength=len(seen)), np.bincount(at, weights=toxic[row], minlength=len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(n.astype(np.int64)), pa.array(bad.astype(np.int64))], ["word", "n", "bad"])

    total, toxic = sample.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total or not toxic or toxic == total:
        return Model({}, -1e-9 if not toxic else 5.0)
    rate = toxic / total
    seen = sample.mapInArrow(count, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(f"n >= {LEAST_DOCS}")
    telling = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = [r.word for r in seen.orderBy(telling.desc(), "word").limit(VOCABULARY).select("word").collect()]
    vocabulary = sorted({*best, *(f"^{w}$" for w in NAMES)})
    place = {w: k for k, w in enumerate(vocabulary)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the sample by their features; and, with toxic -n, features that n swaps have taken away (below 0) and brought."""
        lookup = Lookup(place)
        for block in S.blocks(batches, "text", SCORED):
            row, at = _pairs(block.column("text"), lookup)
            edges = np.searchsorted(row, np.arange(block.num_rows + 1))
            changed: dict[tuple[int, ...], int] = {}
            for text in block.column("text").to_pylist():
                for own, other in swaps(text) if _NAMED.search(text) else ():
                    before, after = ({k for w in words for k in lookup(w)} for words in (own, other))
                    key = (*sorted(~k for k in before - after), *sorted(after - before))
                    changed[key] = changed.get(key, 0) + 1
            lists = [at[a:b] for a, b in zip(edges, edges[1:], strict=False)] + list(changed)
            toxic = block.column("toxic").to_pylist() + [-n for n in changed.values()]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "at"])

    # at most about twice `rows` rows of vocabulary places, and the kinds of swaps, as flat arrays
    got = sample.mapInArrow(placed, "toxic int, at array<int>").toArrow().combine_chunks()
    y, of, flat = got["toxic"].to_numpy(), pc.list_value_length(got["at"]).to_numpy(), pc.list_flatten(got["at"]).to_numpy()
    del got
    row = np.repeat(np.arange(len(y)), of)
    own = y >= 0
    x = np.zeros((int(own.sum()), len(vocabulary)), np.uint8)
    mine = own[row]
    x[(np.cumsum(own) - 1)[row[mine]], flat[mine]] = 1
    kinds = ((np.cumsum(~own) - 1)[row[~mine]], flat[~mine], -y[~own] / max(1, len(x)))
    w, b = fit(x, y[own].astype(np.float64), kinds)
    S.release()
    return Model(dict(zip(vocabulary, w.tolist(), strict=True)), b)


def fit(x: np.ndarray, y: np.ndarray, kinds: tuple[np.ndarray, np.ndarray, np.ndarray], swap: float = SWAP) -> tuple[np.ndarray, float]:
    """Weights and bias by the mean log loss, the ridge, and the squared score changes under swaps.

    kinds gives every kind of swap by entries (its number, the feature that came, or ~ of the one that went) and its share.
    """
    d = x.shape[1]
    share = np.where(y > 0.5, TOXIC_ROW, 1.0)
    share /= share.sum()
    of, at, often = kinds
    sign, at = np.where(at < 0, -1.0, 1.0), np.where(at < 0, ~at, at).astype(np.int64)
    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, g2, gb2 = np.zeros(d), 0.0, np.zeros(d), 0.0
    part = np.empty((ROWS, d), np.float32)
    for step in range(1, STEPS + 1):
        gw, gb, now = 2 * RIDGE * w, 0.0, w.astype(np.float32)
        for a in range(0, len(x), ROWS):  # floats of a few rows at a time
            own = part[: min(ROWS, len(x) - a)]
            np.copyto(own, x[a : a + ROWS])
            p = 1 / (1 + np.exp(-np.clip(own @ now + b, -30, 30)))
            pull = (p - y[a : a + ROWS]) * share[a : a + ROWS]
            gw += own.T @ pull.astype(np.float32)
            gb += float(pull.sum())
        if len(often):
            change = np.bincount(of, weights=sign * w[at], minlength=len(often))
            gw += 2 * swap * np.bincount(at, weights=sign * (often * change)[of], minlength=d)
        vw, vb = 0.9 * vw + 0.1 * gw, 0.9 * vb + 0.1 * gb
        g2, gb2 = 0.99 * g2 + 0.01 * gw**2, 0.99 * gb2 + 0.01 * gb**2
        rate = 0.1 * (1 - step / (STEPS + 1))
        w -= rate * (vw / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
        b -= rate * (vb / (1 - 0.9**step)) / (np.sqrt(gb2 / (1 - 0.99**step)) + 1e-8)
    return w, float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """toxic_score of every text: with the id, or with carry beside all columns of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = S.others(docs, "toxic_score") if carry else [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        lookup = Lookup({w: k for k, w in enumerate(model.weights)})
        weights = np.fromiter(model.weights.values(), np.float64, len(model.weights))
        for block in S.blocks(batches, "text", SCORED):
            row, at = _pairs(block.column("text"), lookup)
            z = model.bias + np.bincount(row, weights=weights[at] if len(at) else None, minlength=block.num_rows)
            yield pa.RecordBatch.from_arrays([*(block.column(k) for k in range(len(kept))), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*kept, "toxic_score"])

    own = docs.select(*(S.quoted(c).alias(f"kept_{k}") for k, c in enumerate(kept)), S.quoted(text_col).alias("text"))
    return own.mapInArrow(run, S.fields(docs, kept, "toxic_score double"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs, labels = S.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(F.pmod(S.crc_of_id(), F.lit(5)) == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
