"""Cosine retrieval over unit vectors: exact by blocks of queries, or by random-hyperplane buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors that are shipped to executors at once, and vectors that a task compares with them at once.
BLOCK, SLICE = 4096, 512


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str, query_vector: str) -> DataFrame:
    """The k nearest of each query by 1 - dot product, rounded to six digits; ties go to the smaller id.

    Queries go to the executors in blocks of a fixed size, each a matrix. A task keeps its best k of each query, so the
    shuffle carries k rows a query and task, whatever the number of vectors.
    """
    return _nearest(vectors, queries, k, id_col, vector_col, query_id, query_vector)


@dataclass
class Probes:
    """The buckets that each query of a block looks into: its own in every table, and those that differ in one sign."""

    planes: np.ndarray
    bits: int
    probed: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray, bits: int, tables: int, seed: int) -> Probes:
        planes = np.random.default_rng(seed).normal(size=(tables * bits, matrix.shape[1]))
        out = cls(planes, bits, np.zeros((len(matrix), tables << bits), bool))
        own, rows = out.buckets(matrix), np.arange(len(matrix))[:, None]
        for flipped in (0, *(1 << b for b in range(bits))):
            out.probed[rows, own ^ flipped] = True
        return out

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each vector, with its bucket in every table."""
        tables = len(self.planes) // self.bits
        signs = (vectors @ self.planes.T > 0).reshape(len(vectors), tables, self.bits) @ (1 << np.arange(self.bits)).astype(np.int64)
        return signs + (np.arange(tables) << self.bits)

    def meet(self, vectors: np.ndarray) -> np.ndarray:
        """Whether a query, by row, looks into a bucket of a vector, by column."""
        out = np.zeros((len(self.probed), len(vectors)), bool)
        for column in self.buckets(vectors).T:
            out |= self.probed[:, column]
        return out


def _best(table: pa.Table, k: int) -> pa.Table:
    """The first k rows of each query by distance, then id."""
    table = table.sort_by([("query", "ascending"), ("distance", "ascending"), ("id", "ascending")]).combine_chunks()
    query = table["query"].to_numpy()
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
    return table.filter(pa.array(place < k))


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str, query_vector: str, buckets: Callable[[np.ndarray], Probes] | None = None) -> DataFrame:
    """The k nearest of each query, with buckets of those that meet it there. Ids keep their types."""
    spark = vectors.sparkSession
    id_type, query_type = vectors.schema[id_col].dataType, queries.schema[query_id].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])
    parts = max(1, -(-queries.count() // BLOCK))
    near = None
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        rows = own.select(query_id, query_vector).toArrow()
        if not rows.num_rows:
            continue
        matrix = _matrix(rows.column(1).combine_chunks())
        shipped = spark.sparkContext.broadcast((rows.column(0).combine_chunks(), matrix, buckets(matrix) if buckets else None))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, matrix, probed = shipped.value
            held, n = [], 0
            for batch in batches:
                for first in range(0, batch.num_rows, SLICE):
                    key, own = batch.column(0).slice(first, SLICE), _matrix(batch.column(1).slice(first, SLICE))
                    distance = np.round(1 - matrix @ own.T, 6)
                    if probed is not None:
                        distance[~probed.meet(own)] = np.inf
                    # all that are no further than the k-th, ties too; ids decide among them later
                    last = np.partition(distance, k - 1, 1)[:, k - 1 : k] if k < distance.shape[1] else np.inf
                    query, row = np.nonzero((distance <= last) & np.isfinite(distance))
                    held.append(pa.table([pa.array(query), key.take(pa.array(row)), pa.array(distance[query, row])], ["query", "id", "distance"]))
                    n += len(query)
                    if n > 4 * k * len(ids) + 100_000:
                        held = [_best(pa.concat_tables(held), k)]
                        n = held[0].num_rows
            if n:
                best = _best(pa.concat_tables(held), k)
                yield from pa.table([ids.take(best["query"].combine_chunks()), best["id"], best["distance"]], ["query_id", "id", "distance"]).to_batches()

        found = vectors.select(id_col, vector_col).where(F.col(vector_col).isNotNull()).mapInArrow(run, schema)
        near = found if near is None else near.unionByName(found)
    if near is None:
        near = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "rank", "distance")


def lsh_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str, query_vector: str, bits: int = 6, tables: int = 12, seed: int = 11) -> DataFrame:
    """Approximate neighbours: vectors in a bucket of signs that the query looks into in one of the tables, then ranked exactly.

    A query looks into its own bucket and into those that differ from it in one sign, as a true neighbour is often just
    across one plane.
    """
    return _nearest(vectors, queries, k, id_col, vector_col, query_id, query_vector, lambda matrix: Probes.of(matrix, bits, tables, seed))


class Embedder(Protocol):
    """Unit vectors of texts, a row each; one embedder is made for each task."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class LetterEmbedder:
    """Offline stand-in, no model: how often each letter of a to z occurs in the lower-case text, as a unit vector (zeros for none)."""

    def embed(self, texts: list[str]) -> np.ndarray:
        counts = np.array([[t.count(chr(97 + k)) for k in range(26)] for t in map(str.lower, texts)], float).reshape(len(texts), 26)
        return counts / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-300)


def embed(df: DataFrame, text_col: str, make: Callable[[], Embedder], out: str = "vector", batch: int = 256) -> DataFrame:
    """df with the unit vector of a text, batch texts at a time; a null text counts as empty."""
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for whole in batches:
            for first in range(0, whole.num_rows, batch):
                own = whole.slice(first, batch)
                made = embedder.embed([t or "" for t in own.column("embedded").to_pylist()])
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(list(made), pa.list_(pa.float64()))], [*kept, out])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select(*kept, F.col(text_col).alias("embedded")).mapInArrow(run, schema)
