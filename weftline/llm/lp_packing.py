"""Best-fit packing of token pieces into sequences by a configuration linear program.

The program has one row per piece length and one column per configuration (a multiset of lengths that fits a sequence).
Multiplicative weights over the rows choose columns, a knapsack dynamic program prices them, and rounding down gives
whole sequences; what rounding leaves goes through the program again, and its last remainder is placed best-fit
decreasing, group by group. How full a column must be to be taken at once is tried from nearly full to any fill, as some
histograms have no full columns and others lose by loose ones; the plan of fewest sequences stands. All of this sees only the length histogram (at most `capacity` numbers), so its cost does
not depend on the number of pieces. Pieces then take the places of their length by rank.

Defined results: a null text counts as empty (the end id alone); equal rows are packed each on its own; a document longer
than a sequence is cut so that its first piece may be shorter; a very long text is cut like any other, with one block of its
own in a worker; columns other than the id and the text are ignored, whatever their names; an empty table packs into no sequence.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Bytes of text that are encoded at once: workers stay small beside the JVM's heap.
PACKED = 1 << 20

CAPACITY = 1024
#: Steps of the weights in a round of the program, rounds, and the step's size.
STEPS, ROUNDS, RATE = 200, 4, 0.3
#: Fills that a column must have to be taken in a round, tried in turn until a plan has at most so many times the sequences that the tokens need.
FILLS, ENOUGH = (0.995, 0.98, 0.95, 0.9, 0.8, 0.0), 1.005
#: Rows of one length that a task ranks, about.
RANKED_ROWS = 500_000

Config = tuple[tuple[int, int], ...]


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack: the multiset of lengths of the largest value that fits."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = value[:k] + best[c - lengths[:k]]
            j = k - 1 - int(np.argmax(gain[::-1]))  # the longest of equals: short pieces fill gaps later
            if gain[j] > best[c] + 1e-12:
                best[c], pick[c] = gain[j], j
    got: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            got[int(lengths[pick[c]])] += 1
            c -= int(lengths[pick[c]])
    return dict(got)


def fractional(counts: dict[int, int], capacity: int) -> dict[Config, float]:
    """Near-optimal configurations and their amounts for these demands, by multiplicative weights."""
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths.tolist()], float)
    place = {x: k for k, x in enumerate(lengths.tolist())}
    weight, covered = (lengths / capacity) ** 1.1, np.zeros(len(lengths))  # long pieces first
    amount: dict[Config, float] = defaultdict(float)
    for _ in range(STEPS):
        config = price(lengths, weight, capacity)
        rows, copies = np.array([place[x] for x in config]), np.array(list(config.values()), float)
        step = float((need[rows] / copies).min())
        amount[tuple(sorted(config.items()))] += step
        share = step * copies / need[rows]
        covered[rows] += share
        weight[rows] *= np.exp(-RATE * share)
        if covered.min() >= 1:
            break
    return amount


def layouts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Lengths in a sequence, and how many sequences are so filled; together they hold exactly counts."""
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best, fewest = [], None
    for fill in FILLS:
        for last in sorted({fill, 0.0}, reverse=True):
            plan = planned(counts, capacity, fill, last)
            used = sum(times for _, times in plan)
            if fewest is None or used < fewest:
                best, fewest = plan, used
            if fewest <= ENOUGH * least:
                return best
    return best


def planned(counts: dict[int, int], capacity: int, fill: float, last: float) -> list[tuple[list[int], int]]:
    """A plan by columns that fill this share of a sequence at least, in the last round the share `last`."""
    left = {x: n for x, n in counts.items() if n > 0}
    out: list[tuple[list[int], int]] = []
    for x in [x for x in left if x == capacity]:
        out.append(([x], left.pop(x)))
    for k in range(ROUNDS):
        if not left:
            break
        for config, amount in sorted(fractional(left, capacity).items(), key=lambda x: (-x[1] * sum(a * b for a, b in x[0]), x[0])):
            if sum(a * b for a, b in config) < (fill if k < ROUNDS - 1 else last) * capacity:
                continue  # rather left to the next round or to best fit
            times = min([int(amount), *(left.get(x, 0) // n for x, n in config)])
            if times > 0:
                out.append(([x for x, n in reversed(config) for _ in range(n)], times))
                for x, n in config:
                    left[x] -= n * times
        left = {x: n for x, n in left.items() if n > 0}
    groups: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by room
    for x in sorted(left, reverse=True):
        n = left[x]
        for room in sorted(r for r in groups if r >= x):
            while n and groups[room]:
                filled, times = groups[room].pop()
                fit = room // x
                whole = min(times, n // fit)
                if whole:
                    groups[room - fit * x].append((filled + [x] * fit, whole))
                    n -= whole * fit
                rest = times - whole
                if rest and 0 < n < fit:
                    groups[room - n * x].append((filled + [x] * n, 1))
                    n, rest = 0, rest - 1
                if rest:
                    groups[room].append((filled, rest))
                    if not n:
                        break
            if not n:
                break
        fit = capacity // x
        if n >= fit:
            groups[capacity - fit * x].append(([x] * fit, n // fit))
        if n % fit:
            groups[capacity - (n % fit) * x].append(([x] * (n % fit), 1))
    return out + [(filled, times) for of_room in groups.values() for filled, times in of_room if times]


def places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks of a length that take one offset in consecutive sequences."""
    rows, used, base = [], defaultdict(int), 0
    for filled, times in plan:
        offset = 0
        for x in filled:
            rows.append((x, used[x], base, offset))
            used[x] += times
            offset += x
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": (cols[0] << 40) + cols[1], "rank": cols[1], "sequence": cols[2], "offset": cols[3]}


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: piece, start, length and the checksum of their ids, and row, by which pieces are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = S.rank_encoder(path), 1_000_003 * TaskContext.get().partitionId()
        for block in S.blocks(batches, "text", PACKED):
            ids, n = encode(block.column("text"))
            row, piece, start, length, crc = [], [], [], [], []
            data, end, at = ids.astype("<u4").tobytes(), S.pack([end_id]), 0
            for k, size in enumerate(n.tolist()):
                own = data[4 * at : 4 * (at + size)] + end
                at += size
                total, a, p = size + 1, 0, 0
                b = total % capacity or min(total, capacity)
                while a < total:
                    row.append(k), piece.append(p), start.append(a), length.append(b - a), crc.append(zlib.crc32(own[4 * a : 4 * b]))
                    a, b, p = b, b + capacity, p + 1
            spread = pa.array(np.arange(made, made + len(row)))
            made += len(row)
            yield pa.RecordBatch.from_arrays([block.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), spread], ["id", "piece", "start", "length", "ids_crc32", "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, row long")


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    made = S.cut(pieces(docs, path, end_id, capacity, id_col, text_col), "pieces")
    rows = made.count()
    salts = min(1024, max(16, rows // RANKED_ROWS))
    salted = made.withColumn("salt", F.pmod(F.col("row"), F.lit(salts)).cast("int"))
    # at most capacity x salts rows come to the driver
    seen = salted.groupBy("length", "salt").count().collect()
    counts: dict[int, int] = defaultdict(int)
    first = np.zeros((capacity + 1, salts), np.int64)
    for length, salt, n in sorted(map(tuple, seen)):
        first[length, salt] = counts[length]
        counts[length] += n
    spots = places(layouts(dict(counts), capacity))
    shipped = spark.sparkContext.broadcast((spots, first))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots, first = shipped.value
        for batch in batches:
            length, salt, rn = (batch.column(c).to_numpy() for c in ("length", "salt", "rn"))
            rank = first[length, salt] + rn - 1
            at = np.searchsorted(spots["key"], (length << 40) + rank, side="right") - 1
            sequence = spots["sequence"][at] + rank - spots["rank"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(spots["offset"][at])], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")).cast("long"))
    return ranked.mapInArrow(put, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(S.documents(spark, sf_dir), S.tokenizer_path("byte_bpe_50k.json"), end_id=2)
