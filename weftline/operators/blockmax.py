"""BM25 top-k over document shards with block bounds: exact, without a table of queries by documents.

A shard holds some thousands of documents in the order of their lengths and the postings of all their tokens; a block is a
run of its documents. For a token and a block the highest term frequency is kept, and with the block's shortest length
it bounds what the token can give any document there. A task searches a shard for every query: blocks are taken in the order of
their bounds, and in a block only documents that have a token without which the k-th best score can't be reached; the
other, frequent tokens are looked up for those documents alone. What is below the k-th best is never scored, and what
leaves a task are k rows a query.

A token's postings lie in as many shards as its documents do, so no key is hot. Queries go out in blocks of a fixed size,
and over many shards with the k-th best scores of a first pass over documents that have a query's rarest tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of a block; documents and tokens that a shard has at most, one document at least.
BLOCK, SHARD_DOCS, SHARD_TOKENS = 64, 32_768, 1_500_000
#: Documents whose tokens are counted at once while a shard is made: beyond them only postings are held.
PIECE = 512
#: Queries that are shipped to executors at once.
QUERIES = 4096
#: Postings of a query's rarest tokens, for each wanted document, that a shard's search begins with.
RARE = 100
#: Tokens that are looked up between two looks at what a document can still reach: 1, 1, 1, 2, 3, 5 and so on.
STEPS = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 1 << 30]
#: Shards beyond which a first pass over documents with a query's rarest tokens finds what the k-th best score is at least.
SEEDED = 16
#: Scores are rounded to six digits before they are ordered, so bounds give way by more than that.
SLACK = 1e-6


def schema(id_type: T.DataType) -> T.StructType:
    """A shard's rows: one without a token has the documents' ids and lengths, the others a token's postings."""
    ints = T.ArrayType(T.IntegerType())
    named = [("shard", T.StringType()), ("token", T.StringType()), ("ids", T.ArrayType(id_type)), ("lengths", ints), ("docs", ints), ("tfs", ints), ("blocks", ints), ("block_tfs", ints)]
    return T.StructType([T.StructField(*x) for x in named])


def _piece(batch: pa.RecordBatch, first: int, only: pa.Array | None) -> tuple:
    """ids, lengths, distinct tokens, and of every posting its token, its document (from first on) and its frequency."""
    lists = batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    token, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    if only is not None:
        wanted = pc.is_in(coded.dictionary, only).to_numpy(zero_copy_only=False)
        token, doc = token[wanted[token]], doc[wanted[token]]
    post, tf = np.unique(token * max(1, len(sizes)) + doc, return_counts=True)
    token, doc = np.divmod(post, max(1, len(sizes)))
    used, token = np.unique(token, return_inverse=True)
    return batch.column(0), sizes, coded.dictionary.take(pa.array(used)), token.astype(np.int32), (first + doc).astype(np.int32), tf.astype(np.int32)


def _shard(name: str, pieces: list[tuple], out: pa.Schema) -> list[pa.RecordBatch]:
    """The rows of one shard: documents by length, postings by token and document. The pieces are used up."""
    ids, sizes = pa.concat_arrays([x[0] for x in pieces]), np.concatenate([x[1] for x in pieces])
    coded = pa.concat_arrays([x[2] for x in pieces]).dictionary_encode()
    of_piece = np.append(0, np.cumsum([len(x[2]) for x in pieces]))
    index = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(sizes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    post = np.concatenate([index[a + x[3]].astype(np.int64) * len(order) + place[x[4]] for a, x in zip(of_piece.tolist(), pieces, strict=False)])
    tf = np.concatenate([x[5] for x in pieces])
    pieces.clear()
    by = np.argsort(post)
    post, tf = post[by], tf[by]
    del by
    token, doc = np.divmod(post, max(1, len(order)))
    starts = np.flatnonzero(np.diff(token, prepend=-1))
    cell = np.flatnonzero(np.diff(token * len(order) + doc // BLOCK, prepend=-1))
    most = np.maximum.reduceat(tf, cell) if len(cell) else tf
    n = len(starts)
    of_token = np.append(np.searchsorted(cell, starts), len(cell))
    lists_of = lambda flat, offsets: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
    edges = np.append(starts, len(token))
    postings = [pa.array([name] * n), coded.dictionary.take(pa.array(token[starts])), pa.nulls(n, out.field("ids").type), pa.nulls(n, out.field("lengths").type), lists_of(doc, edges), lists_of(tf, edges), lists_of(doc[cell] // BLOCK, of_token), lists_of(most, of_token)]
    whole = np.array([0, len(order)])
    own = pa.ListArray.from_arrays(pa.array(whole.astype(np.int32)), ids.take(pa.array(order)))
    head = [pa.array([name]), pa.nulls(1, pa.string()), own, lists_of(sizes[order], whole), *(pa.nulls(1, out.field(c).type) for c in ("docs", "tfs", "blocks", "block_tfs"))]
    return [pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(rows, out, strict=True)], schema=out) for rows in (head, postings)]


def shards(docs: DataFrame, id_col: str, tokens: Column, only: list[str] | None = None, prefix: str = "", docs_each: int = SHARD_DOCS) -> DataFrame:
    """The shards of the documents, made where they are read, without a shuffle. only: the tokens that get postings."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = schema(docs.schema[id_col].dataType)
    shipped = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, few = to_arrow_schema(made), pa.array(shipped.value, pa.string()) if shipped else None
        held, rows, size, n = [], 0, 0, 0
        part = TaskContext.get().partitionId()
        for whole in batches:
            for first in range(0, whole.num_rows, PIECE):
                batch = whole.slice(first, PIECE)
                held.append(_piece(batch, rows, few))
                rows += batch.num_rows
                size += int(held[-1][1].sum())
                if rows >= docs_each or size >= SHARD_TOKENS:
                    yield from _shard(f"{prefix}{part}-{n}", held, out)
                    rows, size, n = 0, 0, n + 1
                    pa.default_memory_pool().release_unused()
        if held:
            yield from _shard(f"{prefix}{part}-{n}", held, out)

    return docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")).mapInArrow(run, made)


def _merged(name: str, postings: pa.Table, heads: pa.Table, out: pa.Schema) -> list[pa.RecordBatch]:
    """One shard of the live documents of some; heads: of (their names), ids, lengths and the places that are dead."""
    flat = lambda table, c: table[c].combine_chunks().flatten()
    sizes = lambda table, c: pc.fill_null(pc.list_value_length(table[c]), 0).to_numpy().astype(np.int64)
    begins = np.append(0, np.cumsum(sizes(heads, "ids")))
    live = np.ones(begins[-1], bool)
    live[np.repeat(begins[:-1], sizes(heads, "dead")) + flat(heads, "dead").to_numpy(zero_copy_only=False).astype(np.int64)] = False
    if not live.any():
        return []
    shard = pc.index_in(postings["shard"], heads["of"].combine_chunks()).to_numpy().astype(np.int64)
    counts = sizes(postings, "docs")
    doc = np.repeat(begins[shard], counts) + flat(postings, "docs").to_numpy(zero_copy_only=False)
    kept = live[doc]
    coded = postings["token"].combine_chunks().dictionary_encode()
    used, token = np.unique(np.repeat(coded.indices.to_numpy(zero_copy_only=False), counts)[kept], return_inverse=True)
    place, tf = (np.cumsum(live) - 1)[doc[kept]], flat(postings, "tfs").to_numpy(zero_copy_only=False)[kept]
    lengths = flat(heads, "lengths").to_numpy(zero_copy_only=False)[live]
    return _shard(name, [(flat(heads, "ids").filter(pa.array(live)), lengths.astype(np.int64), coded.dictionary.take(pa.array(used)), token.astype(np.int32), place.astype(np.int32), tf)], out)


def merge(table: DataFrame, dead: DataFrame | None = None, prefix: str = "", docs_each: int = SHARD_DOCS, tokens_each: int = SHARD_TOKENS) -> DataFrame:
    """Shards of a table's live documents: those of up to half a shard together, up to one and a half, the others each alone.

    Postings go from shard to shard as they are: a row for each token of a shard is shuffled, not one for each of its places.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = table.schema
    heads = table.where("token IS NULL").select("shard", "ids", "lengths")
    if dead is None:
        heads = heads.withColumn("dead", F.array().cast("array<int>"))
    else:
        heads = heads.join(dead.groupBy("shard").agg(F.collect_set("place").alias("dead")), "shard", "left").withColumn("dead", F.coalesce("dead", F.array().cast("array<int>")))  # a shard's documents at most
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    of_size = heads.select("shard", (F.size("ids") - F.size("dead")).alias("docs"), (total(F.col("lengths")) - total(F.transform("dead", lambda p: F.get("lengths", p)))).alias("words"))
    small = (F.col("docs") * 2 <= docs_each) & (F.col("words") * 2 <= tokens_each)
    before = Window.partitionBy("small").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    upto = lambda c, each: F.floor(F.coalesce(F.sum(c).over(before), F.lit(0)) / each).cast("string")
    group = F.when(F.col("small"), F.concat_ws(".", upto("docs", docs_each), upto("words", tokens_each))).otherwise(F.concat(F.lit("="), "shard"))
    groups = of_size.withColumn("small", small).select("shard", F.concat(F.lit(prefix), group).alias("to"))

    def run(key: tuple, postings: pa.Table, heads: pa.Table) -> pa.Table:
        rows = pa.Table.from_batches(_merged(key[0].as_py(), postings, heads, to_arrow_schema(made)), to_arrow_schema(made))
        pa.default_memory_pool().release_unused()
        return rows

    own = table.where("token IS NOT NULL").select("shard", "token", "docs", "tfs").join(F.broadcast(groups), "shard")  # a row for each shard
    of = heads.select(F.col("shard").alias("of"), "ids", "lengths", "dead").join(F.broadcast(groups.select(F.col("shard").alias("of"), F.col("to").alias("into"))), "of")
    return own.groupBy("to").cogroup(of.groupBy("into")).applyInArrow(run, made)


def lost(table: DataFrame, dead: DataFrame) -> DataFrame:
    """token and df: in how many of the dead(shard, place) documents a token of a shard is."""
    places = dead.groupBy(F.col("shard").alias("of")).agg(F.collect_set("place").alias("places"))  # a shard's documents at most
    own = table.where("token IS NOT NULL").select("shard", "token", "docs").join(F.broadcast(places.select(F.col("of").alias("shard"))), "shard", "left_semi")  # a row for each shard

    def run(postings: pa.Table, places: pa.Table) -> pa.Table:
        docs, at = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for t, c in ((postings, "docs"), (places, "places")))
        gone = np.zeros(1 + max(docs.max(initial=0), at.max(initial=0)), bool)
        gone[at] = True
        token = np.repeat(np.arange(postings.num_rows), pc.list_value_length(postings["docs"]).to_numpy())
        df = np.bincount(token[gone[docs]], minlength=postings.num_rows)
        some = np.flatnonzero(df)
        return pa.table([postings["token"].take(pa.array(some)), pa.array(df[some])], ["token", "df"])

    return own.groupBy("shard").cogroup(places.groupBy("of")).applyInArrow(run, "token string, df long")


def tokens(table: DataFrame) -> DataFrame:
    """token and df over all shards."""
    return table.where("token IS NOT NULL").groupBy("token").agg(F.sum(F.size("docs")).alias("df"))


def corpus(table: DataFrame) -> DataFrame:
    """One row: n documents and their mean length avgdl."""
    return table.where("token IS NULL").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), (F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)) / F.sum(F.size("ids"))).alias("avgdl"))


@dataclass
class Shard:
    """One shard's postings of the queries' tokens as flat arrays, and the search in it."""

    ids: pa.Array
    lengths: np.ndarray
    norm: np.ndarray
    row: dict[str, int]
    docs: np.ndarray
    tfs: np.ndarray
    cells: np.ndarray  # by token: first and after last cell
    cell_block: np.ndarray
    cell_tf: np.ndarray
    cell_post: np.ndarray  # first posting of each cell, and the end
    dead: np.ndarray  # whether a document is gone
    scored: int = 0
    met: int = 0

    @classmethod
    def of(cls, postings: pa.Table, head: pa.Table, k1: float, b: float, avgdl: float) -> Shard:
        lengths = head["of_lengths"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        flat = lambda c: postings[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(postings["blocks"]).to_numpy().astype(np.int64)
        docs, blocks = flat("docs").astype(np.int64), flat("blocks").astype(np.int64)
        token = np.repeat(np.arange(postings.num_rows), pc.list_value_length(postings["docs"]).to_numpy())
        starts = np.flatnonzero(np.diff(token * (len(lengths) + 1) + docs // BLOCK, prepend=-1))
        ids = head["of_ids"].combine_chunks().flatten()
        norm = k1 * (1 - b + b * lengths / avgdl) if avgdl else np.full(len(lengths), k1 * (1 - b))
        row = {t: k for k, t in enumerate(postings["token"].to_pylist())}
        dead = np.zeros(-(-len(lengths) // BLOCK) * BLOCK, bool)
        if "of_dead" in head.column_names:
            dead[head["of_dead"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = True
        return cls(ids, lengths, norm, row, docs, flat("tfs").astype(float), np.append(0, np.cumsum(counts)), blocks, flat("block_tfs").astype(float), np.append(starts, len(docs)), dead)

    def search(self, query: list[tuple[str, float]], k: int, floor: float, seeds: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places and rounded scores of all documents that may be among the best k and reach floor; with seeds only of some that are likely to."""
        own = [(self.row[t], idf) for t, idf in query if t in self.row]
        if not own:
            return np.zeros(0, np.int64), np.zeros(0)
        blocks = -(-len(self.lengths) // BLOCK)
        at = np.concatenate([np.arange(self.cells[r], self.cells[r + 1]) for r, _ in own])
        term = np.repeat(np.arange(len(own)), [self.cells[r + 1] - self.cells[r] for r, _ in own])
        idf, block = np.array([x for _, x in own]), self.cell_block[at]
        bound = np.zeros((len(own), blocks))
        bound[term, block] = idf[term] * self.cell_tf[at] / (self.cell_tf[at] + self.norm[block * BLOCK])
        self.met += int((self.cell_post[at + 1] - self.cell_post[at]).sum())
        whole = bound.sum(0)
        order = np.argsort(-whole, kind="stable")
        order = order[whole[order] > 0]
        found, score = np.zeros(0, np.int64), np.zeros(0)
        begun = self._rare(own, bound, at, term, idf, block, k)
        if seeds:
            return begun
        if len(begun[1]) >= k:
            floor = max(floor, np.partition(begun[1], len(begun[1]) - k)[len(begun[1]) - k])
        first, size = 0, max(-(-k // BLOCK), 4)
        while first < len(order):
            part = order[first : first + size]
            part = part[whole[part] >= floor - SLACK]
            if not len(part):
                break
            new, points = self._in_blocks(part, bound, at, term, idf, block, floor)
            found, score = np.concatenate([found, new]), np.concatenate([score, points])
            if len(score) >= k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
                kept = score >= floor
                found, score = found[kept], score[kept]
            first, size = first + size, size * 4
        return found, score

    def _rare(self, own: list[tuple[int, float]], bound: np.ndarray, at: np.ndarray, term: np.ndarray, idf: np.ndarray, block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that have most of the query's rarest tokens, with their scores: the k-th best of all is not below theirs."""
        counts = np.array([self.cell_post[self.cells[r + 1]] - self.cell_post[self.cells[r]] for r, _ in own])
        order = np.argsort(counts, kind="stable")
        few = order[: np.searchsorted(np.cumsum(counts[order]), RARE * k) + 1]
        post = np.concatenate([np.arange(self.cell_post[self.cells[own[t][0]]], self.cell_post[self.cells[own[t][0] + 1]]) for t in few])
        weight = np.repeat(idf[few], counts[few])
        self.scored += len(post)
        docs, spot = np.unique(self.docs[post], return_inverse=True)
        tf = self.tfs[post]
        points = np.bincount(spot, weight * tf / (tf + self.norm[self.docs[post]]))
        points[self.dead[docs]] = 0
        best = docs[np.argsort(-points, kind="stable")[: 2 * k]]
        only = np.zeros(len(self.dead), bool)
        only[best] = True
        return self._in_blocks(np.unique(best // BLOCK), bound, at, term, idf, block, -np.inf, only)

    def _in_blocks(self, part: np.ndarray, bound: np.ndarray, at: np.ndarray, term: np.ndarray, idf: np.ndarray, block: np.ndarray, floor: float, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some blocks that may reach floor, with their scores; of only, if that is given."""
        here = bound[:, part]
        by = np.argsort(here, 0)
        sums = np.cumsum(np.take_along_axis(here, by, 0), 0)
        few = (sums < floor - SLACK).sum(0)  # the tokens of least bounds, which together don't reach it
        place = np.empty_like(by)
        np.put_along_axis(place, by, np.arange(len(by))[:, None], 0)
        depth = np.full(bound.shape, -1)  # how far a token is from the greatest of these; below 0: it is needed
        depth[:, part] = few - 1 - place
        spot = np.full(bound.shape[1], -1)
        spot[part] = np.arange(len(part))
        inside = spot[block] >= 0
        deep = depth[term, block]
        total = np.zeros(len(part) * BLOCK)
        seen = np.zeros(len(total), bool)

        def add(cells: np.ndarray, alive: np.ndarray | None) -> None:
            starts, counts = self.cell_post[at[cells]], self.cell_post[at[cells] + 1] - self.cell_post[at[cells]]
            if not len(counts):
                return
            ends = np.cumsum(counts)
            post = np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])
            doc, weight = self.docs[post], np.repeat(idf[term[cells]], counts)
            local = spot[doc // BLOCK] * BLOCK + doc % BLOCK
            if alive is not None:
                some = alive[local]
                post, doc, weight, local = post[some], doc[some], weight[some], local[some]
            self.scored += len(post)
            tf = self.tfs[post]
            total[:] += np.bincount(local, weight * tf / (tf + self.norm[doc]), len(total))
            seen[local] = True

        chosen = None if only is None else only.reshape(-1, BLOCK)[part].ravel()
        add(np.flatnonzero(inside & (deep < 0)), chosen)
        alive, lo = seen & ~self.dead.reshape(-1, BLOCK)[part].ravel(), 0
        for hi in STEPS:  # the tokens that are not needed, from the greatest bound on, for documents that may still reach it
            left = np.maximum(few - lo, 0)
            rest = np.where(left > 0, np.take_along_axis(sums, np.maximum(left - 1, 0)[None], 0)[0], 0)
            alive &= total + np.repeat(rest, BLOCK) >= floor - SLACK
            if not left.any() or not alive.any():
                break
            has = np.zeros(bound.shape[1], bool)
            has[part[np.flatnonzero(alive.reshape(-1, BLOCK).any(1))]] = True
            add(np.flatnonzero(inside & (deep >= lo) & (deep < hi) & has[block]), alive)
            lo = hi
        local = np.flatnonzero(alive)
        score = np.round(total[local], 6)
        kept = score >= floor
        return part[local[kept] // BLOCK] * BLOCK + local[kept] % BLOCK, score[kept]


@dataclass
class Index:
    """Shards with what scores need of the whole corpus: tokens(token, df) and corpus(n, avgdl); dead(shard, place): documents that are gone."""

    table: DataFrame
    tokens: DataFrame
    corpus: DataFrame
    dead: DataFrame | None = None

    @classmethod
    def of(cls, table: DataFrame) -> Index:
        return cls(table, tokens(table), corpus(table))


def top_k(index: Index, wanted: DataFrame, k: int, k1: float, b: float, seen: Callable[[str, int], None] | None = None, counts: bool = False) -> DataFrame:
    """query_id, id and score of each query's best k of every shard, the best k of all among them. wanted: query_id, token, once each.

    With counts a score is the number of the query's tokens that a document has, whatever k1 and b.
    seen, for tests in one process, is told the numbers of postings that queries met and that were scored.
    """
    spark = index.table.sparkSession
    n, avgdl = index.corpus.first()
    id_type, query_type = index.table.schema["ids"].dataType.elementType, wanted.schema["query_id"].dataType
    made = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if counts:
        idf, k1, b = F.lit(1.0), 0.0, 0.0
    queries = wanted.join(index.tokens, "token").groupBy("query_id").agg(F.collect_list(F.struct("token", idf.alias("idf"))).alias("terms"))
    parts = max(1, -(-wanted.select("query_id").distinct().count() // QUERIES))
    outs = []
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        rows = own.collect()
        if not rows:
            continue
        names = sorted({t["token"] for r in rows for t in r["terms"]})
        few = F.broadcast(spark.createDataFrame([(x,) for x in names], "token string"))  # of one block of queries
        table = index.table.join(few, "token", "left_semi").select("shard", "token", "docs", "tfs", "blocks", "block_tfs")
        heads = index.table.where("token IS NULL").select(F.col("shard").alias("of"), F.col("ids").alias("of_ids"), F.col("lengths").alias("of_lengths"))
        if index.dead is not None:
            gone = index.dead.groupBy(F.col("shard").alias("of")).agg(F.collect_set("place").alias("of_dead"))  # a shard's documents at most
            heads = heads.join(gone, "of", "left")
        lists = [[(t["token"], t["idf"]) for t in r["terms"]] for r in rows]
        key_type = _arrow(query_type)

        def searched(floors: dict[int, float], first: bool, lists=lists, rows=[r["query_id"] for r in rows], table=table, heads=heads, key_type=key_type) -> DataFrame:
            shipped = spark.sparkContext.broadcast((lists, rows, floors))

            def run(postings: pa.Table, head: pa.Table) -> pa.Table:
                lists, keys, floors = shipped.value
                shard = Shard.of(postings, head, k1, b, avgdl or 0.0) if postings.num_rows and head.num_rows else None
                query, place, score = [], [], []
                for q, terms in enumerate(lists if shard else []):
                    found, points = shard.search(terms, k, floors.get(q, -np.inf), first)
                    if len(found) > k:  # ties of the last one go by id
                        by = pa.table([pa.array(points), shard.ids.take(pa.array(found))], ["score", "id"])
                        best = pc.sort_indices(by, [("score", "descending"), ("id", "ascending")]).to_numpy()[:k]
                        found, points = found[best], points[best]
                    query.append(np.full(len(found), q))
                    place.append(found)
                    score.append(points)
                pa.default_memory_pool().release_unused()
                if shard and seen:
                    seen("met", shard.met), seen("scored", shard.scored)
                query = np.concatenate([np.zeros(0, np.int64), *query])
                ids = shard.ids if shard else pa.array([], _arrow(id_type))
                return pa.table([pa.array([keys[q] for q in query.tolist()], key_type), ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *place]))), pa.array(np.concatenate([np.zeros(0), *score]))], ["query_id", "id", "score"])

            return table.groupBy("shard").cogroup(heads.groupBy("of")).applyInArrow(run, made)

        floors: dict[int, float] = {}
        if heads.limit(SEEDED + 1).count() > SEEDED:
            kth = Window.partitionBy("query_id").orderBy(F.col("score").desc())
            first = searched({}, True).withColumn("n", F.row_number().over(kth)).where(F.col("n") == k).select("query_id", "score")
            at = {r["query_id"]: q for q, r in enumerate(rows)}
            floors = {at[r["query_id"]]: r["score"] for r in first.collect()}
        outs.append(searched(floors, False))
    return reduce(DataFrame.unionByName, outs) if outs else spark.createDataFrame([], made)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
