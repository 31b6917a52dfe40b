"""Token ids in binary shards compressed by a grammar of repeated pairs (Re-Pair).

A shard repeats: count the adjacent pairs of symbols exactly (those of equal symbols without overlaps), give the most
frequent ones a nonterminal each, and replace them, the more frequent one first where two places overlap. It ends when no
pair has LEAST places or the 16-bit symbols are used up. Many pairs are replaced in a pass; no pair spans a document's
end. The shard keeps the rules, how many ids each nonterminal stands for, and where each document begins among the
symbols: a document is decoded without the ones before it, and an id of it by descending into the one symbol that the
expansion lengths lead to.

Texts are encoded before anything is moved: ids go to a table as 16-bit numbers, and that table is range-partitioned by
id and a number of the row, so that rows of one id are split like any others. A task writes its partition's shards one
after another, and the numbers of ids before a shard come from one small total a partition. Shard files are named after
the attempt that wrote them, and only those that a finished task has named are read.

Defined results: a null text counts as empty (the end id alone); rows of equal id follow each other in any order; null
ids come first, and an id that is no whole number is refused; a vocabulary has fewer than 65,535 ids; a very long text is a shard of its own; columns other than the id and the text are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared as S

END_ID = 1
#: Symbols, a nonterminal's least number of places (its rule and length take as many bytes as so many places save, and twice that), and new rules of a pass at most.
SYMBOLS, LEAST, PASS_RULES = 65_535, 8, 2_600
#: Ids of a shard, about, and tasks that write shards, at most: beyond, each writes more of them.
SHARD_IDS, WRITERS = 2_000_000, 50_000
MAGIC = b"WLRP0002"
_HEAD = "<8sQIIQ"  # magic, documents, rules, terminals, symbols
#: No pair of symbols, and the bits and multipliers of the table that finds a pair's rule.
_NONE, _BITS, _ODD = np.uint32(0xFFFFFFFF), 18, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def pair_keys(seq: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """At each place its symbol and the next as one number; none at a document's last symbol, and at every other place of a run of one symbol."""
    key = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
    key[ends[:-1]] = _NONE
    twin = np.flatnonzero(seq[:-1] == seq[1:])
    twin = twin[key[twin] != _NONE]
    if len(twin):
        place = np.arange(len(twin))
        begin = np.maximum.accumulate(np.where(np.diff(twin, prepend=-2) > 1, place, 0))
        key[twin[(place - begin) & 1 == 1]] = _NONE
    return key


def frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of least places or more and their exact numbers, the most frequent first."""
    ordered = np.sort(key)
    starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    n = np.diff(starts, append=len(ordered))
    pair = ordered[starts]
    often = (n >= least) & (pair != _NONE)
    pair, n = pair[often], n[often]
    order = np.argsort(-n, kind="stable")
    return pair[order], n[order]


def clear(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which places stay: of overlapping ones the more frequent pair's; the most frequent pair of all keeps every place."""
    near, stay = np.diff(at) == 1, np.ones(len(at), bool)
    stay[1:] &= ~(near & (rank[:-1] <= rank[1:]))
    stay[:-1] &= ~(near & (rank[1:] < rank[:-1]))
    return stay


def compress(ids: np.ndarray, counts: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the documents' numbers of symbols, and the rules as pairs; counts are the documents' numbers of ids, 1 at least."""
    seq, ends = ids.astype(np.uint16), np.cumsum(counts) - 1
    rules, made, turn = [np.zeros((0, 2), np.uint16)], terminals, 0
    slot = np.full(1 << _BITS, -1, np.int16)
    while len(seq) > 1 and made < SYMBOLS:
        key = pair_keys(seq, ends)
        # near the end more pairs than there are symbols left, as some fail: the most frequent of the rest are taken
        room = SYMBOLS - made
        pair = frequent(key, LEAST)[0][: min(PASS_RULES, 2 * room)]
        if not len(pair):
            break
        # pairs in one slot: the most frequent goes now, others in a later pass, by another multiplier
        mix, turn = np.uint32(_ODD[turn % len(_ODD)]), turn + 1
        own = (pair * mix) >> np.uint32(32 - _BITS)
        slot[own[::-1]] = np.arange(len(pair) - 1, -1, -1)
        rank = slot[(key * mix) >> np.uint32(32 - _BITS)]
        slot[own] = -1
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        same = pair[rank] == key[at]
        at, rank = at[same], rank[same]
        good = np.bincount(rank[clear(at, rank)], minlength=len(pair)) >= LEAST
        good &= np.cumsum(good) <= room
        taken = good[rank]
        at, rank = at[taken], rank[taken]
        stay = clear(at, rank)  # places beside those of pairs not taken are free again
        at, rank = at[stay], rank[stay]
        seq[at] = (made + np.cumsum(good) - 1)[rank]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, ends = np.compress(keep, seq), ends - np.searchsorted(at + 1, ends, side="right")
        rules.append(np.stack([pair[good] >> np.uint32(16), pair[good] & np.uint32(0xFFFF)], 1).astype(np.uint16))
        made += int(good.sum())
    return seq, np.diff(ends, prepend=-1), np.concatenate(rules)


def expansions(rules: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols' ids one after another, where each begins, and how many they are; rules of equal depth are expanded at once."""
    size, depth = [1] * terminals, [0] * terminals
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
        depth.append(1 + max(depth[a], depth[b]))
    sizes, depths = np.array(size, np.int64), np.array(depth, np.int64)
    start, pairs = S.excl(sizes), rules.astype(np.int64)
    flat = np.empty(int(sizes.sum()), np.uint16)
    flat[:terminals] = np.arange(terminals)
    for level in range(1, int(depths.max(initial=0)) + 1):
        own = np.flatnonzero(depths == level)
        parts = pairs[own - terminals].ravel()
        flat[S.runs(start[own], sizes[own])] = S.ragged(flat, start[parts], sizes[parts])
    return flat, start, sizes


def write_shard(out, keys: list, ids: np.ndarray, counts: np.ndarray, terminals: int) -> None:
    """One file: head, rules, expansion lengths, and for each document its id, its number of ids and of symbols; then symbols."""
    seq, symbols, rules = compress(ids, counts, terminals)
    size = [1] * terminals
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
    out.write(struct.pack(_HEAD, MAGIC, len(counts), len(rules), terminals, len(seq)))
    out.write(rules.astype("<u2").tobytes())
    out.write(np.array(size[terminals:], "<u4").tobytes())
    out.write(np.array([k is None for k in keys], np.uint8).tobytes())
    out.write(np.array([k or 0 for k in keys], "<i8").tobytes())
    out.write(counts.astype("<u8").tobytes())
    out.write(symbols.astype("<u8").tobytes())
    out.write(seq.astype("<u2").tobytes())


class Shard:
    """An open shard: documents by place, and ids of a document by their place in it."""

    def __init__(self, src):
        self.src = src
        magic, self.documents, n_rules, self.terminals, self.symbols = struct.unpack(_HEAD, src.read(struct.calcsize(_HEAD)))
        if magic != MAGIC:
            raise ValueError("not a shard")
        take = lambda kind, n: np.frombuffer(src.read(np.dtype(kind).itemsize * n), kind)
        self.rules, self.lengths = take("<u2", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        absent, keys = take("u1", self.documents), take("<i8", self.documents)
        self.keys = [None if a else k for a, k in zip(absent.tolist(), keys.tolist(), strict=True)]
        self.counts, self.sizes = take("<u8", self.documents).astype(np.int64), take("<u8", self.documents).astype(np.int64)
        self.first = S.excl(self.sizes)
        self.base = struct.calcsize(_HEAD) + 8 * n_rules + 25 * self.documents
        self.table = None

    def _symbols(self, a: int, b: int) -> np.ndarray:
        self.src.seek(self.base + 2 * int(self.first[a]))
        return np.frombuffer(self.src.read(2 * int(self.sizes[a:b].sum())), "<u2").astype(np.int64)

    def decode(self, a: int, b: int) -> np.ndarray:
        """Ids of the documents from place a to before place b; only their own symbols are read."""
        if a >= b:
            return np.zeros(0, np.uint16)
        self.table = self.table or expansions(self.rules, self.terminals)
        flat, start, size = self.table
        seq = self._symbols(a, b)
        return S.ragged(flat, start[seq], size[seq])

    def ids(self, place: int, a: int, b: int) -> list[int]:
        """Ids a to before b of the document at place; expansion lengths tell which symbols hold them, and rules elsewhere are not expanded."""
        seq = self._symbols(place, place + 1)
        length = lambda s: int(self.lengths[s - self.terminals]) if s >= self.terminals else 1
        ends = np.cumsum(np.where(seq >= self.terminals, self.lengths[np.maximum(seq - self.terminals, 0)] if len(self.lengths) else 1, 1))
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b, side="left") + 1
        at, out = int(ends[i - 1]) if i else 0, []
        stack = seq[i:j].tolist()[::-1] if a < b else []
        while stack and at < b:
            s = stack.pop()
            n = length(s)
            if at + n <= a:
                at += n
            elif s < self.terminals:
                out.append(s)
                at += 1
            else:
                left, right = self.rules[s - self.terminals].tolist()
                stack += [right, left]
        return out


def encoded(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """id, row (a number that rows of one id differ in), ids (16 bits each, with the end id) and n of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = S.library_encoder(path, False), TaskContext.get().partitionId() << 40
        for block in S.blocks(batches, "text", 2 * S.BLOCK_BYTES):
            ids, n = encode(block.column("text"))
            ends = np.cumsum(n + 1)
            whole, inside = np.full(int(ends[-1]), END_ID, "<u2"), np.ones(int(ends[-1]), bool)
            inside[ends - 1] = False
            whole[inside] = ids
            data, edges = whole.tobytes(), np.concatenate([[0], 2 * ends])
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(np.arange(row, row + len(n))), binary.cast(pa.binary()), pa.array(n + 1)], ["id", "row", "ids", "n"])
            row += len(n)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, row long, ids binary, n long")


def write(docs: DataFrame, path: str, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, write shards under root in ascending order of ids, and return the table of shards: part, number, file, documents, ids."""
    terminals = S.vocabulary_size(path)
    if terminals >= SYMBOLS:
        raise ValueError(f"{terminals} ids leave no 16-bit symbols for rules")
    place = S.scratch(docs.sparkSession, "ids")
    own = S.cut(encoded(docs, path, id_col, text_col), "ids", place)
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        part, done = TaskContext.get().partitionId(), []

        def put(held: list[pa.RecordBatch]) -> None:
            name = f"{part:08d}-{len(done):06d}-{uuid.uuid4().hex}.rp"
            keys = [k for b in held for k in b.column("id").to_pylist()]
            counts = np.concatenate([b.column("n").to_numpy() for b in held])
            ids = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for b in held for x in b.column("ids")])
            with system.open_output_stream(f"{base}/{name}") as out:
                write_shard(out, keys, ids, counts, terminals)
            done.append((part, len(done), f"{root}/{name}", len(counts), len(ids)))

        held, n = [], 0
        for block in S.blocks(batches, "ids", 2 * SHARD_IDS):
            own = int(block.column("n").to_numpy().sum())
            if held and n + own > 1.5 * SHARD_IDS:
                put(held)
                held, n = [], 0
            held.append(block)
            n += own
        if held:
            put(held)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["part", "number", "file", "n_docs", "n_ids"])

    parts = max(1, min(WRITERS, -(-total // SHARD_IDS)))
    ranged = own.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").select("id", "ids", "n")
    shards = S.cut(ranged.mapInArrow(run, "part long, number long, file string, n_docs long, n_ids long"), "shard-table")
    S.drop_path(docs.sparkSession, place)
    return shards


def read(spark: SparkSession, shards: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Every document of the shards: its id, the ids before it, its number of ids and their checksum."""
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row a partition
    before, start = [], 0
    for part, n in totals:
        before.append((part, start))
        start += n
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.join(F.broadcast(spark.createDataFrame(before, "part long, base long")), "part").withColumn("at", F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as src:
                    shard = Shard(src)
                    data = shard.decode(0, shard.documents).astype("<u4").tobytes()
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, pa.int64()), pa.array(at + starts), pa.array(shard.counts), pa.array(crc, pa.int64())], [id_name, "start", "n_tokens", "ids_crc32"])

    spread = max(1, min(10_000, len(totals)))  # about a shard a task
    return placed.select("file", "at").repartition(spread).mapInArrow(run, f"`{id_name}` long, start long, n_tokens long, ids_crc32 long")


def op6(spark, sf_dir: str) -> DataFrame:
    root = S.scratch(spark, "shards")
    return read(spark, write(S.documents(spark, sf_dir), S.tokenizer_path("word_bpe_49k.json"), root))
