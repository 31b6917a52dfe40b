"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves a whole pre-token that is a vocabulary entry; any other pre-token is merged
by a heap of candidate pairs over a linked list of its bytes. Distinct pieces of a block are encoded once, so both tiers
see each of them once a block.

Defined results: a null text counts as empty (no ids, the digest of no bytes); repeated rows each give a row; columns
other than the id and the text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (d.astype(np.uint64) * _MIX)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class PerfectHash:
    """Minimal perfect hash by bucket displacement: n keys take exactly n slots; a slot's key tells members from others."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = len(keys)
        self.n, self.buckets = n, max(1, -(-n // per_bucket))
        self.shift = np.zeros(self.buckets, np.int64)
        h = _hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        slot_of, free = np.full(n, -1, np.int64), np.ones(n, bool)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = S.excl(sizes)
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[starts[b] : starts[b] + sizes[b]]
            if len(own) < 2:
                break
            first, own_h = 1, h[own]
            while True:  # 64 displacements at a time
                tried = np.arange(first, first + 64)
                at_all = (_scramble(own_h[None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
                fits = free[at_all].all(1)
                fits[fits] = [len(set(x)) == len(own) for x in at_all[fits].tolist()]
                if fits.any():
                    break
                first += 64
            d = int(tried[fits][0])
            at = at_all[fits][0]
            self.shift[b], free[at], slot_of[own] = d, False, at
        left = iter(np.flatnonzero(free).tolist())
        for k in np.flatnonzero(sizes[bucket] == 1).tolist():  # a lone key takes a free slot by its number
            slot_of[k] = next(left)
            self.shift[bucket[k]] = -1 - slot_of[k]
        self.key_at = np.argsort(slot_of)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = _hashes(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        hashed = (_scramble(h, np.maximum(d, 0)) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -1 - d, hashed)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        import public_tokenizers

        ranks = S.read_ranks(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.tokens = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.hash = PerfectHash(self.tokens)
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        # a pair of ids merges if its bytes are a token; the token's rank is its id
        self.pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        self.flat = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)
        self.size = np.zeros(by_id[-1][1] + 1, np.int64)
        self.size[[r for _, r in by_id]] = [len(t) for t, _ in by_id]
        self.start = S.excl(self.size)
        self.memo = S.Memo()
        self.encode = S.PieceEncoder.of(self.pieces)

    def whole(self, keys: list[bytes]) -> list[int]:
        """First tier: the id of each key that is a token, -1 for others."""
        at = self.hash.key_at[self.hash.slots(keys)]
        tokens = self.tokens
        return [i if tokens[k] == key else -1 for key, k, i in zip(keys, at.tolist(), self.ids[at].tolist(), strict=True)]

    def merge(self, key: bytes) -> list[int]:
        """Second tier: the lowest-ranked pair first, the leftmost of equals; links skip merged bytes."""
        n, pairs = len(key), self.pairs
        ids = [self.of_byte[b] for b in key]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r * n + k) for k in range(n - 1) if (r := pairs.get((ids[k] << 32) | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = divmod(heapq.heappop(heap), n)
            j = after[k] if ids[k] >= 0 else n
            if j >= n or pairs.get((ids[k] << 32) | ids[j]) != r:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j] = r, -1
            after[k] = q = after[j]
            if q < n:
                before[q] = k
                if (s := pairs.get((r << 32) | ids[q])) is not None:
                    heapq.heappush(heap, s * n + k)
            p = before[k]
            if p >= 0 and (s := pairs.get((ids[p] << 32) | r)) is not None:
                heapq.heappush(heap, s * n + p)
        return [i for i in ids if i >= 0]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of strings that no pre-token crosses."""
        split = [self.pattern.findall(p) for p in pieces]
        own = list({t for ts in split for t in ts})
        known = dict(zip(own, self.memo.all(own, self.pretokens), strict=True))
        return [b"".join(map(known.__getitem__, ts)) for ts in split]

    def pretokens(self, own: list[str]) -> list[bytes]:
        keys = [t.encode() for t in own]
        return [S.pack([i]) if i >= 0 else S.pack(self.merge(key)) for key, i in zip(keys, self.whole(keys), strict=True)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids one after another."""
        ids = ids.astype(np.int64)
        return S.ragged(self.flat, self.start[ids], self.size[ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Ids of every whole text, and what they decode to: their number and digests; with keep also ids and decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for block in S.blocks(batches, "text"):
            ids, n = own.encode(block.column("text"))
            ends = np.cumsum(n)
            sizes = np.concatenate([[0], np.cumsum(own.size[ids.astype(np.int64)])])
            data = own.decode(ids).tobytes()
            packed = ids.astype("<u4").tobytes()
            spans = [(a, b) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            out = [
                block.column("id"), pa.array(n, pa.int64()),
                pa.array([hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
                pa.array([hashlib.sha256(data[sizes[a] : sizes[b]]).hexdigest() for a, b in spans], pa.string()),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                out += [pa.array([ids[a:b].tolist() for a, b in spans], pa.list_(pa.int64())), pa.array([data[sizes[a] : sizes[b]] for a, b in spans], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded binary" if keep else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return encode_decode(S.documents(spark, sf_dir), S.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
