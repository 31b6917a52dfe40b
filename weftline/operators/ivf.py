"""A vector index on disk: cells as partition folders, vectors as byte codes of what remains of them beside a cell's centre.

A search reads the codes of the cells that it probes, which take a quarter of the vectors' bytes or less, and bounds every dot
product by the code's own error. Only vectors whose upper bound reaches the k-th best lower bound are read whole and ranked
exactly. Over all cells the result is therefore that of the exact search; with probes, cells away from a query are left out,
their folders are not read, and neighbours there are lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector import BLOCK, SLICE, _matrix

#: Vectors that the cells' centres are fitted on, at most, taken by a hash of the id; rounds of fitting; most cells.
SAMPLE, ROUNDS, CELLS = 20_000, 10, 4096
#: Distances are rounded to six digits before they are ordered.
SLACK = 2e-6


def centres(rows: np.ndarray, cells: int) -> np.ndarray:
    """Centres of cells by k-means; the first rows begin, and a cell that loses its rows stays where it was."""
    out = rows[:cells].copy()
    for _ in range(ROUNDS):
        near = (rows @ out.T - (out**2).sum(1) / 2).argmax(1)
        sums, counts = np.zeros_like(out), np.bincount(near, minlength=len(out))
        np.add.at(sums, near, rows)
        out = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], out)
    return out


def build(vectors: DataFrame, id_col: str, vector_col: str, path: str, cells: int | None = None) -> Index:
    """Write the index of all vectors that are not null. cells: about the square root of their number unless given."""
    spark = vectors.sparkSession
    own = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.monotonically_increasing_id().alias("spot"))
    n = own.count()
    if not n:
        raise ValueError("there are no vectors")
    sample = _matrix(own.orderBy(F.xxhash64("id", "spot")).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks())
    made = centres(sample, max(1, min(CELLS, len(sample), cells or round(n**0.5))))
    shipped = spark.sparkContext.broadcast(made)
    fields = [("id", own.schema["id"].dataType), ("spot", T.LongType()), ("cell", T.IntegerType()), ("code", T.BinaryType()), ("scale", T.DoubleType()), ("error", T.DoubleType()), ("vector", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shipped.value
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                x = _matrix(part.column("vector"))
                cell = (x @ made.T - (made**2).sum(1) / 2).argmax(1)
                rest = x - made[cell]
                scale = np.maximum(np.abs(rest).max(1), 1e-300) / 127
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                error = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(1))
                columns = [part.column("id"), part.column("spot"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error), part.column("vector")]
                yield pa.RecordBatch.from_arrays(columns, [f for f, _ in fields])

    coded = own.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))
    coded.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(made)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return Index(spark, path)


@dataclass
class Index:
    spark: SparkSession
    path: str

    def top_k(self, queries: DataFrame, k: int, query_id: str, query_vector: str, probes: int | None = None) -> DataFrame:
        """query_id, id, rank and distance of the k nearest, by distance and then id: exactly, or in the probes nearest cells of each query."""
        table = self.spark.read.parquet(f"{self.path}/cells")
        made = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()  # CELLS rows at most
        made = _matrix(made.column("centre").combine_chunks())
        parts = max(1, -(-queries.count() // BLOCK))
        kinds = T.StructType([queries.schema[query_id], table.schema["id"], T.StructField("distance", T.DoubleType())])
        out = self.spark.createDataFrame([], T.StructType([T.StructField("query_id", kinds[0].dataType), *kinds.fields[1:]]))
        for part in range(parts):
            own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
            rows = own.select(query_id, F.col(query_vector).cast("array<double>")).toArrow()
            if rows.num_rows:
                found = self.candidates(table, made, _matrix(rows.column(1).combine_chunks()), k, probes)
                out = out.unionByName(self._exact(table, found, rows, out.schema))
        best = Window.partitionBy("query_id").orderBy("distance", "id")
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "rank", "distance")

    def candidates(self, table: DataFrame, made: np.ndarray, matrix: np.ndarray, k: int, probes: int | None = None) -> DataFrame:
        """query (its place), spot and cell of all vectors that may be among the k nearest."""
        to_centre = matrix @ made.T
        allowed = None
        if probes is not None and probes < len(made):
            allowed = np.zeros(to_centre.shape, bool)
            near = (2 * to_centre - (made**2).sum(1)).argsort(1)[:, -probes:]
            np.put_along_axis(allowed, near, True, 1)
            table = table.where(F.col("cell").isin(np.flatnonzero(allowed.any(0)).tolist()))
        shipped = self.spark.sparkContext.broadcast((matrix, to_centre, allowed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, to_centre, allowed = shipped.value
            norm = np.sqrt((matrix**2).sum(1))
            best, held, size = np.full((len(matrix), 0), -np.inf), [], 0
            last = np.full(len(matrix), -np.inf)

            def kept() -> list[np.ndarray]:
                query, spot, cell, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
                few = high >= last[query]
                return [x[few] for x in (query, spot, cell, low, high)]

            for batch in batches:
                for first in range(0, batch.num_rows, SLICE):
                    part = batch.slice(first, SLICE)
                    cell, scale, error = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "scale", "error"))
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(part.num_rows, -1)
                    near = to_centre[:, cell] + (matrix @ code.T.astype(float)) * scale
                    slack = norm[:, None] * error + SLACK
                    low, high = near - slack, near + slack
                    if allowed is not None:
                        out = ~allowed[:, cell]
                        low[out], high[out] = -np.inf, -np.inf
                    best = np.concatenate([best, low], 1)
                    if best.shape[1] >= k:
                        best = np.partition(best, best.shape[1] - k, 1)[:, -k:]
                        last = best[:, 0]
                    query, row = np.nonzero((high >= last[:, None]) & np.isfinite(high))
                    held.append((query, part.column("spot").to_numpy()[row], cell[row], low[query, row], high[query, row]))
                    size += len(query)
                    if size > 8 * k * len(matrix) + 100_000:
                        held = [tuple(kept())]
                        size = len(held[0][0])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept()], ["query", "spot", "cell", "low", "high"])

        found = table.select("spot", "cell", "code", "scale", "error").mapInArrow(run, "query long, spot long, cell int, low double, high double")
        own = Window.partitionBy("query")
        ranked = found.withColumn("place", F.row_number().over(own.orderBy(F.col("low").desc())))
        kth = F.max(F.when(F.col("place") == k, F.col("low"))).over(own)
        return ranked.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("query", "spot", "cell")

    def _exact(self, table: DataFrame, found: DataFrame, rows: pa.Table, made: T.StructType) -> DataFrame:
        """The distances of candidates, from whole vectors."""
        shipped = self.spark.sparkContext.broadcast((rows.column(0).combine_chunks(), _matrix(rows.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, matrix = shipped.value
            for batch in batches:
                if batch.num_rows:
                    query = batch.column("query").to_numpy()
                    distance = np.round(1 - (matrix[query] * _matrix(batch.column("vector"))).sum(1), 6)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(query)), batch.column("id"), pa.array(distance)], ["query_id", "id", "distance"])

        whole = table.select("cell", "spot", "id", "vector").join(found, ["cell", "spot"])
        return whole.select("query", "id", "vector").mapInArrow(run, made)
