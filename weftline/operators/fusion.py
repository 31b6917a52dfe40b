"""Fusion of the results of several components, and reranking.

A result table has query_id, id, rank (from 1) and distance (less is better).
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import section_of_json

RRF_CONSTANT = 60


def parse_weights(texts: list[str]) -> dict[str, float]:
    """component=weight texts."""
    out: dict[str, float] = {}
    for text in texts:
        name, sign, value = text.partition("=")
        if not sign or not name.strip() or name.strip() in out:
            raise ValueError(f"{text!r} is no component=weight, or names a component again")
        out[name.strip()] = float(value)
    return out


def normalize_weights(components: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """Equal weights by default; given ones must name all components, be 0 or more, and sum to 1."""
    if not weights:
        return {c: 1 / len(components) for c in components}
    if set(weights) != set(components):
        raise ValueError(f"weights must name exactly {sorted(components)}")
    if any(not math.isfinite(w) or w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must be 0 or more and sum to 1")
    return {c: float(weights[c]) for c in components}


def _stacked(results: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """All components' rows with the component, its place and weight; a rank below 1 is replaced by the place in the list."""
    place = Window.partitionBy("query_id").orderBy("distance", "id")
    rows = [
        df.select("query_id", "id", F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.row_number().over(place)).cast("int").alias("rank"), F.col("distance").cast("double").alias("distance"), F.lit(name).alias("component"), F.lit(k).alias("place"), F.lit((weights or {}).get(name, 1.0)).alias("weight"))
        for k, (name, df) in enumerate(results.items())
    ]
    return reduce(DataFrame.unionByName, rows)


def _provenance() -> list[Column]:
    entry = lambda value, name: F.map_from_entries(F.sort_array(F.collect_list(F.struct("component", value)))).alias(name)
    return [entry("rank", "component_ranks"), entry("distance", "component_distances")]  # a row a component at most


def weighted_rrf(results: dict[str, DataFrame], top_k: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weight / (60 + rank); best first, ties by id; best_component is the one that contributed most, the earlier of equals."""
    stacked = _stacked(results, normalize_weights(list(results), weights))
    share = F.col("weight") / (RRF_CONSTANT + F.col("rank"))
    fused = stacked.groupBy("query_id", "id").agg(
        F.round(F.sum(share), 12).alias("score"), F.max_by("component", F.struct(share.alias("share"), -F.col("place"))).alias("best_component"), *_provenance()
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    out = fused.withColumn("rank", F.row_number().over(best)).withColumn("distance", -F.col("score")).drop("score")
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def union(results: dict[str, DataFrame]) -> DataFrame:
    """Components one after another, each id where it is first seen, no cut; the distance is the new rank."""
    first = _stacked(results).groupBy("query_id", "id").agg(F.min(F.struct("place", "rank")).alias("at"), F.min_by("component", "place").alias("best_component"), *_provenance())
    order = Window.partitionBy("query_id").orderBy("at", "id")
    return first.withColumn("rank", F.row_number().over(order)).withColumn("distance", F.col("rank").cast("double")).drop("at")


#: Strategies by name.
STRATEGIES = {"weighted_rrf": weighted_rrf, "union": lambda results, top_k=None, weights=None: union(results)}


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets: the offline pair scorer."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, texts: DataFrame, queries: DataFrame, score, top_k: int, model: str = "lexical") -> DataFrame:
    """Candidates rescored by score(query, text); ties by the old rank, then id. Texts are joined to candidates only."""
    own = candidates.withColumnRenamed("rank", "original_rank").withColumnRenamed("distance", "original_distance")
    scored = own.join(texts.select("id", "text"), "id").join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", F.round(score(F.col("query"), F.col("text")), 6)).drop("text", "query")
    best = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "original_rank", "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).withColumn("distance", -F.col("rerank_score")).withColumn("rerank_model", F.lit(model))


def presented(results: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Results with what a reader sees: title, section (of the heading path kept as JSON), source_url and text; missing texts are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = chunks.select(F.col(id_col).alias("id"), text("title"), section_of_json("heading_path").alias("section"), text("source_url"), text("text"))
    return results.join(own, "id")


class PairScorer(Protocol):
    """Scores pairs of a query and a text; one is made for each task."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def rerank_by_model(candidates: DataFrame, texts: DataFrame, queries: DataFrame, make: Callable[[], PairScorer], top_k: int, model: str, batch: int = 32) -> DataFrame:
    """rerank with a scorer that sees batch pairs at a time; rerank_seconds is what a pair's batch took, divided by its pairs."""
    own = candidates.join(texts.select("id", "text"), "id").join(queries.select("query_id", "query"), "query_id").select("query_id", "id", "query", "text")
    kinds = T.StructType([own.schema["query_id"], own.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("rerank_seconds", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for whole in batches:
            for first in range(0, whole.num_rows, batch):
                part = whole.slice(first, batch)
                began = time.perf_counter()
                made = scorer.score(list(zip(part.column("query").to_pylist(), part.column("text").to_pylist(), strict=True)))
                each = (time.perf_counter() - began) / part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.float64()), pa.array([each] * part.num_rows)], ["query_id", "id", "score", "rerank_seconds"])

    scored = own.mapInArrow(run, kinds)
    joined = candidates.withColumnRenamed("rank", "original_rank").withColumnRenamed("distance", "original_distance").join(scored, ["query_id", "id"]).withColumn("rerank_score", F.round("score", 6)).drop("score")
    best = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "original_rank", "id")
    return joined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).withColumn("distance", -F.col("rerank_score")).withColumn("rerank_model", F.lit(model))
