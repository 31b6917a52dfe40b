"""N-gram Jaccard join of texts as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct shingle sets of the texts (exact copies are one row), columns are hashed
shingles. As in any sparse product, its pattern comes before its numbers.

Pattern: two sets of similarity t share a column among the first n - ceil(t n) + 1 of each in any common order, so only
those columns count; the order takes columns that a sample shows to be frequent last. Columns are dealt to blocks by
hash. A block sorts its entries by column, parts each column's rows where sizes alone rule a link out, and passes on the
rows that meet. Not all of a column's pairs enter the pattern: first every row with one of its rows (a star, linear in
the column), and then only rows that the stars have not brought together. Large columns are dealt to tasks in tiles of
TILE rows by TILE, and a pair that meets in several columns is compared in one of them. Pairs whose parity sketches already differ in more places than the sizes allow are left out; that
bound is exact: each shingle in just one of two sets flips one bit, so differing bits never exceed the sets' difference.

Numbers: for the pairs of the pattern, whole rows are multiplied column block by column block. Overlap counts accumulate
over the blocks, and after each block the pairs go whose count, with all that is left of the smaller remainder, stays
below the bound that the sizes demand. What is left at the end are links with their exact overlaps.

What is lost nowhere: a link between different sets is either counted in one of the rounds, or its ends are already in
one component. Nothing is capped; a column's rows are held in one task, 20 bytes each, and with their sketches by tiles.

Defined results: a text of fewer words than a shingle is one shingle of its whole sequence; a null or empty text, or one
of white space, has no shingle, links to nothing and is its own component; repeated rows link like other copies; a very
long text is one row like any other; columns other than the id and the text are ignored, whatever their names; an empty
table gives an empty result. Shingles count as equal if 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

#: Words of a shingle, and the least similarity in hundredths.
WIDTH, PERCENT = 5, 80
#: Documents that are looked at for frequent columns (one in SAMPLE_ONE_IN, SAMPLE_ROWS at most), the least number of them that makes a column frequent, and the most columns that are shipped as such.
SAMPLE_ONE_IN, SAMPLE_ROWS, FREQUENT, SHIPPED = 4, 2_000_000, 3, 1_000_000
#: Entries of a block, about.
BLOCK_ENTRIES = 1_000_000
#: Column blocks of the product, by the highest bits of a column; rows of a tile of a large column's rows.
COLUMN_BLOCKS, TILE = 8, 256
#: Entries that a task multiplies at once, about.
PRODUCT_ENTRIES = 2_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending hashes."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    none = np.zeros(0, np.uint64)
    if not len(texts) or offsets[0] == offsets[-1]:
        return [none] * len(texts)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    lower = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.tobytes()))
    lists = pc.ascii_split_whitespace(lower)
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    distinct = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    if "" in distinct:  # at the edges of texts
        word = index != distinct.index("")
        index, row = index[word], row[word]
    words = hashed[index]
    edges = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    with np.errstate(over="ignore"):
        full = sum((words[k : len(words) - width + 1 + k] * _ODD[k % 8] + _ODD[(k + 3) % 8] * np.uint64(k // 8) for k in range(width)), np.uint64(0)) if len(words) >= width else none
        full = _mix(full) if len(full) else none
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a >= width:
                out.append(np.unique(full[a : b - width + 1]))
            elif b > a:
                out.append(_mix(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], np.uint64)))
            else:
                out.append(none)
    return out


def fingerprint(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own))).astype(np.int64))


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the members at each of about len(own) places, as packed bits; the halves of a sketch xor to the next smaller one."""
    bits = 1 << min(16, max(6, int(len(own) - 1).bit_length()))
    parity = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(own: np.ndarray, size: int) -> np.ndarray:
    while len(own) > size:
        half = len(own) // 2
        own = own[:half] ^ own[half:]
    return own


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def linked(both: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest overlap that links sets of a and b members."""
    return -(-percent * (a + b) // (100 + percent))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def sized(docs: DataFrame, width: int) -> DataFrame:
    """id, n (size of the set), node (its name, null if empty) and sketch (about n bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in S.blocks(batches, "text", 4 << 20):
            sets = shingles(block.column("text"), width)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) if len(x) else None for x in sets], pa.int64()), pa.array([sketch(x).tobytes() if len(x) else None for x in sets], pa.binary())], ["id", "n", "node", "sketch"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, node long, sketch binary")


def frequent(docs: DataFrame, rows: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns that FREQUENT sampled documents or more have, ascending, and how many do. At most SHIPPED come to the driver."""
    share = min(1 / SAMPLE_ONE_IN, SAMPLE_ROWS / max(rows, 1))
    picked = docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    parts = max(16, int(share * entries / 4e6))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in S.blocks(batches, "text", 4 << 20):
            sets = shingles(block.column("text"), width)
            flat = np.concatenate(sets)
            part = ((flat >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([flat[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["part", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.frombuffer(x, np.uint64) for batch in batches for x in batch.column("data").to_pylist()]
        if held:
            column, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(column[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["column", "n"])

    found = picked.mapInArrow(emit, "part int, data binary").repartition(parts, "part").mapInArrow(count, "column long, n long")
    got = found.orderBy(F.col("n").desc(), "column").limit(SHIPPED).toPandas()
    columns = got["column"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(columns)
    return columns[order], got["n"].to_numpy(np.int64)[order]


def meetings(docs: DataFrame, entries: int, often: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """Rows that meet in a column and whose sizes allow a link: list (a name of those rows), nodes and sizes, each list once."""
    spark = docs.sparkSession
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BLOCK_ENTRIES))
    shipped = spark.sparkContext.broadcast(often)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, count = shipped.value
        for block in S.blocks(batches, "text"):
            flat, nodes, sizes, lens = [], [], [], []
            for part in S.blocks(iter([block]), "text", 4 << 20):
                for own in shingles(part.column("text"), width):
                    if not len(own):
                        continue
                    k = prefix_length(len(own), percent)
                    if len(columns):
                        at = np.minimum(np.searchsorted(columns, own), len(columns) - 1)
                        rank = np.where(columns[at] == own, count[at], 0)
                        first = own[np.argsort(rank, kind="stable")[:k]]
                    else:
                        first = own[:k]
                    flat.append(first), nodes.append(fingerprint(own)), sizes.append(len(own)), lens.append(len(first))
            if not flat:
                continue
            rows = np.zeros(sum(lens), [("column", "<u8"), ("node", "<i8"), ("n", "<u4")])
            rows["column"], rows["node"], rows["n"] = np.concatenate(flat), np.repeat(np.array(nodes, np.int64), lens), np.repeat(np.array(sizes, np.uint32), lens)
            to = ((rows["column"] >> np.uint64(16)) % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(n_blocks + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([rows[order[cuts[b] : cuts[b + 1]]].tobytes() for b in full], pa.binary())], ["block", "data"])

    kind = [("column", "<u8"), ("node", "<i8"), ("n", "<u4")]

    def multiply(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, kind) for x in table.column("data").to_pylist()])
        rows = rows[np.lexsort((rows["node"], rows["n"], rows["column"]))]
        column, node, n = rows["column"], rows["node"], rows["n"].astype(np.int64)
        new = np.ones(len(rows), bool)
        new[1:] = (column[1:] != column[:-1]) | (node[1:] != node[:-1])  # copies of a set meet as one row
        column, node, n = column[new], node[new], n[new]
        parted = np.ones(len(column), bool)  # the next larger set is too large for this one: none beyond can link to one before
        parted[1:] = (column[1:] != column[:-1]) | (100 * n[:-1] < percent * n[1:])
        starts = np.flatnonzero(parted)
        size = np.diff(np.append(starts, len(column)))
        lists: dict[int, tuple[bytes, bytes]] = {}
        for a, m in zip(starts[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            own = node[a : a + m].tobytes()
            lists[xxhash.xxh3_64_intdigest(own) - (1 << 63)] = (own, n[a : a + m].astype("<i8").tobytes())
        return pa.table([pa.array(list(lists), pa.int64()), pa.array([x[0] for x in lists.values()], pa.binary()), pa.array([x[1] for x in lists.values()], pa.binary())], ["list", "nodes", "sizes"])

    met = docs.mapInArrow(emit, "block int, data binary").groupBy("block").applyInArrow(multiply, "list long, nodes binary, sizes binary")
    return met.groupBy("list").agg(F.first("nodes").alias("nodes"), F.first("sizes").alias("sizes"))


def stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of each list's least node with the others whose sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, others = [], []
            for nodes, sizes in zip(batch.column("nodes").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                node, n = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64)
                k = int(node.argmin())
                near = 100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])
                near[k] = False
                others.append(node[near])
                firsts.append(np.full(len(others[-1]), node[k]))
            if others:
                pairs = np.unique(np.stack([np.concatenate(firsts), np.concatenate(others)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def members(lists: DataFrame, least: int) -> DataFrame:
    """list and node of lists of least rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("nodes")).to_numpy(zero_copy_only=False) // 8
            keep = np.flatnonzero(sizes >= least)
            flat = b"".join(batch.column("nodes")[k].as_py() for k in keep.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("list").take(pa.array(np.repeat(keep, sizes[keep]))), pa.array(np.frombuffer(flat, np.int64))], ["list", "node"])

    return lists.select("list", "nodes").mapInArrow(run, "list long, node long")


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether sketches of sets of n and m members leave room for a link: their difference is at most (100 - percent) / (100 + percent) of n + m."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(x), len(y))
    return (100 + percent) * int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= (100 - percent) * (n + m)


def sketched(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("x", "y", "n", "m")]
            yield batch.select(["a", "b"]).filter(pa.array([may_link(*row, percent) for row in zip(*cols, strict=True)], pa.bool_()))

    x, y = marks.select(F.col("node").alias("a"), F.col("n"), F.col("sketch").alias("x")), marks.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, once: bool) -> DataFrame:
    """node and members (the whole set) of the wanted rows (id and node), from their texts; once: no id occurs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in S.blocks(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([block.column("node"), pa.array([x.tobytes() for x in shingles(block.column("text"), width)], pa.binary())], ["node", "members"])

    # ids of few rows are broadcast, so that texts stay where they are; those of more are joined by a shuffle
    few = wanted.count() <= SHIPPED
    made = docs.join(F.broadcast(wanted) if few else wanted, "id").select("text", "node").mapInArrow(run, "node long, members binary")
    return made if once else made.dropDuplicates(["node"])


_EDGES = (np.arange(1, COLUMN_BLOCKS, dtype=np.uint64) << np.uint64(64 - (COLUMN_BLOCKS - 1).bit_length()))


def block_product(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Overlap counts of one row with others, by column blocks; -1 where a bound has ended the count before its link."""
    cut = lambda x: np.concatenate([[0], np.searchsorted(x, _EDGES), [len(x)]])
    mine, theirs = cut(one), np.stack([cut(x) for x in others])
    sizes = theirs[:, -1]
    need, count, live = least_overlap(len(one), sizes, percent), np.zeros(len(others), np.int64), np.arange(len(others))
    for k in range(COLUMN_BLOCKS):
        own = one[mine[k] : mine[k + 1]]
        part = [others[j][theirs[j, k] : theirs[j, k + 1]] for j in live.tolist()]
        n = theirs[live, k + 1] - theirs[live, k]
        if len(own) and n.any():
            flat = np.concatenate(part)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            count[live] += np.bincount(np.repeat(np.arange(len(live)), n)[hit], minlength=len(live))
        may = count[live] + np.minimum(len(one) - mine[k + 1], sizes[live] - theirs[live, k + 1]) >= need[live]
        count[live[~may]] = -1
        live = live[may]
        if not len(live):
            break
    return count


def product(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs a, b of the pattern, with their overlap counts. Rows of one a meet in runs, which are multiplied together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            x, y = batch.column("x"), batch.column("y")
            entries = pc.binary_length(y).to_numpy().astype(np.int64) // 8
            runs = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
            got = np.full(len(a), -1, np.int64)
            for first, end in zip(runs.tolist(), runs[1:].tolist(), strict=False):
                one = np.frombuffer(x[first].as_buffer(), np.uint64)
                part = np.cumsum(entries[first:end]) // PRODUCT_ENTRIES
                edges = [first, *(first + 1 + np.flatnonzero(np.diff(part))).tolist(), end]
                for i, j in zip(edges, edges[1:], strict=False):
                    got[i:j] = block_product(one, [np.frombuffer(y[k].as_buffer(), np.uint64) for k in range(i, j)], percent)
            links = np.flatnonzero(got >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[links]), pa.array(b[links]), pa.array(got[links])], ["a", "b", "overlap"])

    x, y = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, overlap long")


def forest(node: np.ndarray, group: np.ndarray, n: np.ndarray, own: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of different groups that make a least spanning forest by sketch distance, over pairs that may link."""
    far = np.iinfo(np.int64).max
    best, origin, left = np.full(len(node), far), np.zeros(len(node), np.int64), np.ones(len(node), bool)
    for _ in range(len(node)):
        k = int(np.where(left, best, far).argmin())
        if not left[k]:
            k = int(left.argmax())
        elif 0 <= best[k] < far:
            yield int(node[min(k, origin[k], key=node.__getitem__)]), int(node[max(k, origin[k], key=node.__getitem__)])
        left[k] = False
        differ = np.bitwise_count(own ^ own[k]).sum(1, dtype=np.int64)
        differ = np.where((100 + percent) * differ <= (100 - percent) * (n + n[k]), differ, far)
        differ[group == group[k]] = -1
        nearer = left & (differ < best)
        best[nearer], origin[nearer] = differ[nearer], k


def every(node: np.ndarray, group: np.ndarray, n: np.ndarray, own: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """All pairs of different groups that may link."""
    step = max(1, (4 << 20) // own.size)
    for a in range(0, len(node), step):
        differ = np.bitwise_count(own[a : a + step, None, :] ^ own[None, :, :]).sum(2, dtype=np.int64)
        may = (100 + percent) * differ <= (100 - percent) * (n[a : a + step, None] + n[None])
        may &= (group[a : a + step, None] != group[None]) & (node[a : a + step, None] < node[None])
        for i, j in zip(*np.nonzero(may), strict=True):
            yield int(node[a + i]), int(node[j])


def apart(lists: DataFrame, group: DataFrame, marks: DataFrame, percent: int, choose=every) -> DataFrame:
    """Of each list's rows in different groups, the pairs that choose takes, tile by tile. The first row of a list has been compared."""
    rows = members(lists, 3).join(group, "node", "left").select("list", "node", F.coalesce("group", "node").alias("group"))
    rows = S.cut(rows, "members")
    tiles = F.ceil(F.count(F.lit(1)) / TILE).cast("int")
    open_lists = rows.groupBy("list").agg(F.min("group").alias("g"), F.max("group").alias("h"), tiles.alias("tiles")).where("g <> h").select("list", "tiles")
    held = rows.join(open_lists, "list").join(marks.select("node", "n", "sketch"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # a pair belongs to the least of the lists that have both its rows, and there to one tile
    before = held.groupBy("node").agg(F.sort_array(F.collect_list("list")).alias("lists"))  # a node's columns at most
    held = held.join(before, "node").withColumn("earlier", F.filter("lists", lambda x: x < F.col("list")))
    # a row meets each tile of its list once: in the tile of both numbers
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "group", "n", "sketch", "own", "earlier")

    def compare(table: list[tuple], inside: bool) -> Iterator[tuple[int, int]]:
        width = min(len(x[3]) for x in table) // 8
        node, group, n = (np.array([x[k] for x in table], np.int64) for k in range(3))
        tile, earlier = {x[0]: x[4] for x in table}, {x[0]: x[5] for x in table}
        seen: dict[int, set[int]] = {}
        for a, b in choose(node, group, n, np.stack([fold(np.frombuffer(x[3], np.uint64), width) for x in table]), percent):
            if inside or tile[a] != tile[b]:
                if a not in seen:
                    seen[a] = set(earlier[a])
                if seen[a].isdisjoint(earlier[b]):
                    yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, out = None, [], set()
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(9)]
            for *name, node, group, n, mark, own, earlier in zip(*cols, strict=True):
                if name != now:
                    if len(table) > 1:
                        out.update(compare(table, now[1] == now[2]))
                    now, table = name, []
                table.append((node, group, n, mark, own, earlier))
            if len(out) > 100_000:
                yield pairs_batch(out)
                out = set()
        if len(table) > 1:
            out.update(compare(table, now[1] == now[2]))
        yield pairs_batch(out)

    return spread.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high").mapInArrow(run, "a long, b long").distinct()


def pairs_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and group (the least node reachable) for every node of a link: least labels of neighbours, then of the label's own."""
    both = S.cut(links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), "edges")
    labels = S.cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("group")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("to"), "group"), "to").groupBy("node").agg(F.min("group").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.least("group", "near").alias("group"), F.col("group").alias("was"))
        jump = labels.select(F.col("node").alias("group"), F.col("group").alias("far"))
        new = S.cut(nearer.join(jump, "group", "left").select("node", F.least("group", F.coalesce("far", "group")).alias("group"), "was"), "labels")
        changed = new.where("group <> was").limit(1).count()
        labels = new.select("node", "group")
        if not changed:
            return labels


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links) of every document."""
    own = _named(docs, id_col, text_col)
    rows = S.cut(sized(own, width), "sized")
    total, shingled = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = frequent(own, total, shingled, width)
    lists = S.cut(meetings(own, shingled * (100 - percent) // 100 + total, often, width, percent), "lists")
    once = rows.select("id").distinct().count() == total
    marks = S.cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "marks")
    nodes = marks.select("node", "id")
    pairs = S.cut(sketched(stars(lists, percent), marks, percent), "pairs")
    held = ends(pairs)
    sets = S.cut(sets_of(own, nodes.join(held, "node"), width, once), "sets")
    first = S.cut(product(pairs, sets, percent), "links")
    near = first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("group"))
    up = near.select(F.col("node").alias("group"), F.col("group").alias("top"))
    near = S.cut(near.join(up, "group", "left").select("node", F.coalesce("top", "group").alias("group")), "near")
    for choose in (forest, every):
        pairs = S.cut(apart(lists, near, marks, percent, choose), "pairs")
        wanted = S.cut(ends(pairs).join(held, "node", "left_anti"), "ends")
        sets = sets.unionByName(S.cut(sets_of(own, nodes.join(wanted, "node"), width, once), "sets"))
        held = held.unionByName(wanted)
        more = S.cut(product(pairs, sets, percent), "links")
        near = components(first.select("a", "b").unionByName(more.select("a", "b")))
        first = near.select(F.col("node").alias("a"), F.col("group").alias("b")).where("a <> b")
    group = near
    # the least id of every component, over all copies of its sets
    least = nodes.join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    of_group = least.groupBy("group").agg(F.min("id").alias("component_id"))
    of_node = least.join(of_group, "group").select("node", "component_id")
    joined = rows.join(of_node, "node", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(S.documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS own FROM w),
d AS (SELECT doc_id, len(own)::BIGINT AS n, md5(array_to_string(list_sort(own), chr(10))) AS node FROM s),
r AS (SELECT node, min(doc_id) AS rep FROM d WHERE n > 0 GROUP BY node),
e AS (SELECT doc_id, len(own) AS n, unnest(own) AS g FROM s SEMI JOIN r ON s.doc_id = r.rep),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * inter >= 80 * (na + nb - inter)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS x, a AS y FROM u UNION SELECT reach.x, u.b FROM reach JOIN u ON reach.y = u.a),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT d.doc_id, d.n AS n_shingles, coalesce(c.low, r.rep, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN r ON d.node = r.node AND d.n > 0 LEFT JOIN c ON c.x = r.rep
"""
