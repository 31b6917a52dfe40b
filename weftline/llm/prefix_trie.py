r"""Prefix tries of conversations.

A turn is known by a digest of its role and text, so a conversation is a short string of digests. Conversations of equal
turns become one weighted sequence. Sequences are dealt by the digest of their first turn into buckets of bounded size, and
each bucket builds its tries of dictionaries and folds them from the leaves up, without recursion. A first turn whose
conversations have more turns than a bucket may hold is split by the next turn, again and again until what is left fits: the
nodes above such a split are summed from the tops below them, level by level.

What a task holds is a bucket's turns, at most a few times `TURNS`. The hash of the ids that end at a node needs these in
one order: they are sorted in ranges, joined to strings there, and one task hashes a node's strings as they come and keeps
none, so copies of one conversation may have any share of the rows.

Defined results: null role or text is empty, a null turn comes first, turns of equal number come in the order of their
digests and count each, so repeated rows are turns of their own; rows without a conversation's id belong to none and are
left out; a conversation without turns ends at the root; a very long text is digested whole; extra columns are ignored,
whatever their names; an empty table has no nodes. A single conversation's turns (24 bytes each) have to fit one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Turns that a bucket has about, and that one subtrie may have; subtries with more are split by their next turn.
TURNS = 2048
#: Split subtries up to which their table is broadcast; beyond it the join shuffles.
SHIPPED = 100_000
#: Conversations that share the first turns of one of them, in the rebuilt table; the most turns that are shared.
FAMILY, SHARED = 20, 4
DIGEST = 16
ROOT = ""
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn binary"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def digest(role: str, text: str) -> Column:
    own, said = (F.coalesce(S.quoted(c).cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.md5(F.concat(F.length(own).cast("string"), F.lit(":"), own, said).cast("binary")))


def turn_texts(table: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """turn, role and text: what a node's turn says."""
    return table.select(digest(role, text).alias("turn"), *(F.coalesce(S.quoted(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text")))).dropDuplicates(["turn"])


def conversations(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, an array of (turn, digest, words) in order."""
    said = F.coalesce(S.quoted(text).cast("string"), F.lit(""))
    one = table.where(S.quoted(conv).isNotNull()).select(S.quoted(conv).cast("long").alias("conv_id"), F.struct(S.quoted(turn).alias("turn"), digest(role, text).alias("digest"), words(said).alias("words")).alias("t"))
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Conversations whose first turns are those of their family's first one: crc32(id) % shared of them, before their own later ones."""
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, shared - 1).alias("head"))
    n = (S.crc_of_id("conv_id") % shared).cast("int").alias("n")
    met = convs.select("conv_id", "turns", n, (F.col("conv_id") - F.col("conv_id") % family).alias("head_id")).join(heads, "head_id", "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("n")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    return met.select("conv_id", F.concat(first, own).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """conv_id, digests (one string of bytes), words (an array) and seq, which tells equal sequences."""
    out = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("digests"), F.transform("turns", lambda t: t["words"]).alias("words"))
    return out.withColumn("seq", F.md5("digests"))


# ---------------------------------------------------------------- copies


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sequence as one row: the ids comma-joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        seq, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
        edges = [0, *(k for k in range(1, len(seq)) if seq[k] != seq[k - 1]), len(seq)]
        spans = list(zip(edges, edges[1:], strict=False))
        own = batch.take(pa.array(edges[:-1])).drop_columns(["conv_id"])
        first, counts = [ids[a] for a, _ in spans], [b - a for a, b in spans]
        shown = [",".join(map(str, ids[a:b])).encode() for a, b in spans]
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(first, pa.int64()), pa.array(counts, pa.int64()), pa.array(shown, pa.binary())], names=[*own.schema.names, "first", "n", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence of rows that come in its ids' order; ids are hashed as they come."""
    names, now, sha = ["conv_id", "n", "ends", "digests", "words"], None, None
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    for rows in batches:
        for row in rows.to_pylist():
            if now and now["seq"] == row["seq"]:
                sha.update(b"," + row["ids"])
                now["n"] += row["n"]
                continue
            if now:
                done.append((now["first"], now["n"], sha.hexdigest(), now["digests"], now["words"]))
            now, sha = row, hashlib.sha256(row["ids"])
            if len(done) >= 1000:
                yield batch()
                done.clear()
    if now:
        done.append((now["first"], now["n"], sha.hexdigest(), now["digests"], now["words"]))
        yield batch()


def weighted(seqs: DataFrame) -> DataFrame:
    """conv_id (the least), n, ends (hash of all ids), digests and words of each distinct sequence."""
    runs = seqs.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_joined, "digests binary, words array<long>, seq string, first long, n long, ids binary")
    return runs.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed, "conv_id long, n long, ends string, digests binary, words array<long>")


# ---------------------------------------------------------------- tries


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtries: sequences go on after `depth` turns, below the node `up` whose conversation is up_conv."""
    tops: dict[tuple, int] = {}
    kids: list[dict[bytes, int]] = []
    parent, depth, conv, n, said, ends, turn, above = [], [], [], [], [], [], [], []

    def node(over: int, at: int, of: bytes, count: int, up: tuple | None) -> int:
        kids.append({})
        for values, x in ((parent, over), (depth, at), (conv, None), (n, 0), (said, count), (ends, NO_ENDS), (turn, of), (above, up)):
            values.append(x)
        return len(kids) - 1

    for own, many, end, digests, counts, up, up_conv, start in rows[["conv_id", "n", "ends", "digests", "words", "up", "up_conv", "depth"]].itertuples(index=False):
        at = -1
        for k in range(start, len(counts)):
            of = digests[DIGEST * k : DIGEST * (k + 1)]
            table, key = (tops, (up, of)) if at < 0 else (kids[at], of)
            if (below := table.get(key)) is None:
                below = table[key] = node(at, k + 1, of, int(counts[k]), (up, up_conv) if at < 0 else None)
            at = below
            n[at] += many
            conv[at] = own if conv[at] is None else min(conv[at], own)
        ends[at] = end
    leaves, saved = [0] * len(kids), [(m - 1) * w for m, w in zip(n, said, strict=True)]
    for at in range(len(kids) - 1, -1, -1):  # a node comes before those below it, so backwards is a postorder
        leaves[at] = leaves[at] or 1
        if (over := parent[at]) >= 0:
            leaves[over] += leaves[at]
            saved[over] += saved[at]
    return pd.DataFrame({
        "conv_id": conv, "depth": depth, "parent_conv_id": [conv[p] if p >= 0 else above[k][1] for k, p in enumerate(parent)], "n_convs": n, "n_children": [len(x) for x in kids],
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "turn": turn, "up": [x and x[0] for x in above],
    })


def _met(rows: DataFrame, split: DataFrame, few: bool, how: str) -> DataFrame:
    return rows.join(F.broadcast(split) if few else split, "key", how)


def trie(seqs: DataFrame, turns: int = TURNS) -> DataFrame:
    """A row for each node of the trie of the sequences: NODES. turn is the digest of the node's last turn, null at the root."""
    spark = seqs.sparkSession
    own = S.cut(weighted(seqs), "weighted")
    all_turns, members, least, root_ends = own.agg(F.sum(F.size("words")), F.sum("n"), F.min("conv_id"), F.max(F.when(F.size("words") == 0, F.col("ends")))).first()
    if not members:
        return spark.createDataFrame([], NODES)
    rows = own.where(F.size("words") > 0).withColumns({"up": F.lit(ROOT), "up_conv": F.lit(least).cast("long")})
    fits, splits, depth = [], [], 0
    while True:
        rows = rows.withColumn("key", F.md5(F.substring("digests", 1, DIGEST * (depth + 1))))
        held = rows.groupBy("key", "up", "up_conv").agg(
            F.sum(F.size("words") - depth).alias("turns"), F.count(F.lit(1)).alias("n_seqs"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.min(F.get("words", F.lit(depth))).alias("said"),
            F.coalesce(F.max(F.when(F.size("words") == depth + 1, F.col("ends"))), F.lit(NO_ENDS)).alias("ends_sha256"), F.min(F.substring("digests", DIGEST * depth + 1, DIGEST)).alias("turn"))
        split = S.cut(held.where((F.col("turns") > turns) & (F.col("n_seqs") > 1)).drop("turns", "n_seqs"), "split")
        n = split.count()
        few = n <= SHIPPED
        fits.append((_met(rows, split.select("key"), few, "left_anti") if n else rows).withColumn("depth", F.lit(depth)))
        if not n:
            break
        splits.append(split)
        below = split.select("key", F.col("conv_id").alias("over"))
        on = _met(rows.drop("up", "up_conv"), below, few, "inner").where(F.size("words") > depth + 1)
        depth += 1
        rows = S.cut(on.withColumnRenamed("key", "up").withColumnRenamed("over", "up_conv"), "rows")
    dealt = fits[0]
    for more in fits[1:]:
        dealt = dealt.unionByName(more)
    buckets = max(1, -(-int(all_turns or 0) // turns))
    grown = dealt.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInPandas(build, NODES + ", up string")
    nodes = S.cut(grown, "nodes")
    tops = nodes.where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens")
    out, columns = nodes.drop("up"), [c for c in nodes.columns if c != "up"]
    for level in range(len(splits), 0, -1):
        sums = tops.groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        done = splits[level - 1].join(sums, "key").withColumns({"depth": F.lit(level).cast("long"), "parent_conv_id": F.col("up_conv"), "saved_tokens": F.col("below") + (F.col("n_convs") - 1) * F.col("said")})
        done = S.cut(done.select(*columns, "up"), "joints")
        out, tops = out.unionByName(done.drop("up")), tops.unionByName(done.select("up", "n_leaves", "saved_tokens"))
    root = tops.where(F.col("up") == ROOT).agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    fixed = {"conv_id": F.lit(least).cast("long"), "depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(members).cast("long"), "ends_sha256": F.lit(root_ends or NO_ENDS), "turn": F.lit(None).cast("binary")}
    return out.unionByName(root.withColumns(fixed).select(*columns))


def op11(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    convs = S.cut(conversations(table), "conversations")
    return trie(S.cut(sequences(rebuilt(convs)), "sequences")).drop("turn")


#: Every prefix of every conversation as a row, every node joined with all nodes above it.
SQL = rf"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS p, dg, w FROM t),
c AS (SELECT DISTINCT conv_id, {S.crc_sql("conv_id::VARCHAR")} % 4 AS h FROM o),
r AS (SELECT c.conv_id, 0 AS half, p, dg, w FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND p <= h UNION ALL SELECT c.conv_id, 1 AS half, p, dg, w FROM c JOIN o ON o.conv_id = c.conv_id WHERE p > h),
q AS (SELECT conv_id, list(dg ORDER BY half, p) AS dgs, list(w ORDER BY half, p) AS ws FROM r GROUP BY conv_id),
s AS (SELECT c.conv_id, coalesce(dgs, []) AS dgs, coalesce(ws, []) AS ws FROM c LEFT JOIN q ON q.conv_id = c.conv_id),
x AS (SELECT conv_id, dgs, ws[depth] AS w, len(dgs) AS whole, depth FROM (SELECT *, unnest(range(0, len(dgs) + 1)) AS depth FROM s)),
n AS (SELECT md5(array_to_string(dgs[1:depth], '')) AS key, depth, any_value(dgs[1:depth]) AS path, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = whole), '')) AS ends_sha256 FROM x GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN depth > 0 THEN md5(array_to_string(path[1:depth - 1], '')) END AS parent FROM n),
k AS (SELECT parent AS key, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY parent),
a AS (SELECT md5(array_to_string(path[1:i], '')) AS key, sum((n_convs - 1) * coalesce(w, 0)) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
      FROM (SELECT m.*, n_children, unnest(range(0, depth + 1)) AS i FROM m LEFT JOIN k ON k.key = m.key) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN a ON a.key = m.key LEFT JOIN k ON k.key = m.key LEFT JOIN m AS up ON up.key = m.parent
"""
