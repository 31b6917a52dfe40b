"""Retrieval as one lazy plan: components, fusion, reranking; and its configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, filters, fusion, generation, vector

#: Candidates per wanted row where a reranker follows and no number is given.
CANDIDATES = 5


@dataclass(frozen=True)
class Request:
    """What to retrieve for every row of queries(query_id, query, and vector for vector components)."""

    queries: DataFrame
    top_k: int
    candidate_k: int | None = None
    filters: tuple[filters.Filter, ...] = ()
    filters_enabled: bool = True
    where: dict | None = None

    def __post_init__(self) -> None:
        if self.top_k <= 0 or (self.candidate_k is not None and self.candidate_k <= 0):
            raise ValueError("numbers of results must be positive")

    @property
    def payload(self) -> dict | None:
        return filters.merged(filters.payload(list(self.filters)) if self.filters_enabled else None, self.where)

    @property
    def candidates(self) -> int:
        return self.candidate_k or CANDIDATES * self.top_k


class Component(Protocol):
    """Results query_id, id, rank and distance of a request."""

    name: str

    def retrieve(self, request: Request) -> DataFrame: ...


@dataclass
class KeywordComponent:
    """BM25; the filter follows the ranking unless mode is exact."""

    chunks: DataFrame
    id_col: str = "chunk_id"
    text_col: str = "text"
    mode: str = "compat"
    index: bm25.Index | None = None
    name: str = "bm25"

    def retrieve(self, request: Request) -> DataFrame:
        return bm25.top_k(self.chunks, request.queries, request.top_k, self.id_col, self.text_col, "query_id", "query", request.payload, self.mode, index=self.index)


@dataclass
class VectorComponent:
    """Exact cosine; the filter comes first. Queries without a vector column are embedded."""

    chunks: DataFrame
    id_col: str = "chunk_id"
    vector_col: str = "vector"
    make_embedder: Callable[[], vector.Embedder] = vector.LetterEmbedder
    name: str = "vector"

    def retrieve(self, request: Request) -> DataFrame:
        queries = request.queries if "vector" in request.queries.columns else vector.embed(request.queries, "query", self.make_embedder)
        return vector.top_k(filters.apply(self.chunks, where=request.payload), queries, request.top_k, self.id_col, self.vector_col, "query_id", "vector")


def build(config: RetrievalConfig, chunks: DataFrame, make_embedder: Callable[[], vector.Embedder] | None = None, scorer: Callable | None = None, index: bm25.Index | None = None, make_scorer: Callable[[], fusion.PairScorer] | None = None, model: str = "model") -> Pipeline:
    """The pipeline that a configuration describes, over chunks; a vector component embeds them unless they have vectors.

    Reranking is by scorer, a function of columns, or by make_scorer, which makes a model's scorer of pairs in each task.
    """
    made: list[Component] = []
    for name in config.components:
        if name == "bm25":
            made.append(KeywordComponent(chunks, index=index))
        elif name == "vector":
            own = chunks if "vector" in chunks.columns else vector.embed(chunks, "text", make_embedder or vector.LetterEmbedder)
            made.append(VectorComponent(own))
        else:
            raise ValueError(f"no such component: {name}")
    texts = chunks.select(F.col("chunk_id").alias("id"), "text")
    on = config.reranking
    return Pipeline(made, config.aggregation_strategy, config.component_weights, scorer if on else None, texts, make_scorer if on else None, model)


@dataclass
class Pipeline:
    components: list[Component]
    strategy: str = "weighted_rrf"
    weights: dict[str, float] | None = None
    scorer: Callable | None = None
    texts: DataFrame | None = None
    make_scorer: Callable[[], fusion.PairScorer] | None = None
    model: str = "model"
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = [c.name for c in self.components]
        if not self.names or len(set(self.names)) < len(self.names):
            raise ValueError("components must be given, each once")
        if self.strategy not in fusion.STRATEGIES:
            raise ValueError(f"no such strategy: {self.strategy}")
        if self.weights is not None and self.strategy != "weighted_rrf":
            raise ValueError("only weighted_rrf takes weights")
        if self.scorer is not None and self.make_scorer is not None:
            raise ValueError("one scorer reranks")
        if self.strategy == "weighted_rrf":
            self.weights = fusion.normalize_weights(self.names, self.weights)

    def retrieve(self, request: Request) -> DataFrame:
        reranked = self.scorer is not None or self.make_scorer is not None
        wanted = request if not reranked else replace(request, top_k=request.candidates)
        results = {c.name: c.retrieve(wanted) for c in self.components}
        fused = next(iter(results.values())) if len(results) == 1 else fusion.STRATEGIES[self.strategy](results, wanted.top_k, self.weights)
        if not reranked:
            return fused
        if self.make_scorer is not None:
            return fusion.rerank_by_model(fused, self.texts, request.queries, self.make_scorer, request.top_k, self.model)
        return fusion.rerank(fused, self.texts, request.queries, self.scorer, request.top_k)

    def description(self) -> dict[str, Any]:
        return {"components": self.names, "combination": "hybrid" if len(self.names) > 1 else "single_component", "aggregation_strategy": self.strategy, "component_weights": self.weights if len(self.names) > 1 else None, "reranking": self.scorer is not None or self.make_scorer is not None}


@dataclass(frozen=True)
class RetrievalConfig:
    """The retrieval section of a configuration."""

    top_k: int
    components: tuple[str, ...]
    aggregation_strategy: str
    candidate_k: int | None = None
    reranking: bool = True
    metadata_filters: tuple[str, ...] = ()
    metadata_filters_enabled: bool = True
    topic_filter: dict | None = None
    component_weights: dict[str, float] | None = None
    paths: dict[str, str] = field(default_factory=dict)

    def request(self, queries: DataFrame) -> Request:
        return Request(queries, self.top_k, self.candidate_k if self.reranking else None, tuple(map(filters.parse, self.metadata_filters)), self.metadata_filters_enabled, self.topic_filter)


def parse_config(section: dict[str, Any]) -> RetrievalConfig:
    """Check and read a section; numbers must be positive whole ones, components at least one."""
    if not isinstance(section, dict):
        raise ValueError("retrieval must be a mapping")

    def number(name: str, needed: bool) -> int | None:
        value = section.get(name)
        if value is None and not needed:
            return None
        if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
            raise ValueError(f"retrieval.{name} must be a positive whole number")
        return value

    def texts(name: str) -> tuple[str, ...]:
        value = section.get(name) or []
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise ValueError(f"retrieval.{name} must be a list of strings")
        return tuple(value)

    components, topic = texts("components"), section.get("topic_filter") or {}
    if not components:
        raise ValueError("retrieval.components must name a component")
    weights = section.get("component_weights")
    return RetrievalConfig(
        number("top_k", True), components, section.get("aggregation_strategy", "weighted_rrf"), number("candidate_k", False), bool((section.get("reranking") or {}).get("enabled", True)), texts("metadata_filters"),
        bool(section.get("metadata_filters_enabled", True)), topic.get("where") if topic.get("enabled", True) else None, {k: float(v) for k, v in weights.items()} if weights else None,
        {k: v for k, v in section.items() if isinstance(v, str) and k.endswith(("_path", "_dir"))},
    )


def load_config(path: str) -> RetrievalConfig:
    import yaml

    with open(path, encoding="utf-8") as src:
        return parse_config(yaml.safe_load(src)["retrieval"])


def override(config: RetrievalConfig, **given: Any) -> RetrievalConfig:
    """Given values replace configured ones; new components or a new strategy drop the configured weights."""
    changed = {k: v for k, v in given.items() if v is not None}
    if {"components", "aggregation_strategy"} & changed.keys() and "component_weights" not in changed:
        changed["component_weights"] = None
    return replace(config, **changed)


def answer(pipeline: Pipeline, request: Request, chunks: DataFrame, make_provider: Callable, make_judge: Callable, log: generation.AnswerLog | None = None) -> DataFrame:
    """Retrieve, answer from what was found, and judge: a row for each query, with the errors of its stages."""
    return generation.evaluate(request.queries, fusion.presented(pipeline.retrieve(request), chunks), make_provider, make_judge, log=log)


def review(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results with whether they are relevant."""
    return results.join(qrels.select("query_id", "id", F.lit(True).alias("relevant")).distinct(), ["query_id", "id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
