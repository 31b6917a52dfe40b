"""BM25 keyword retrieval over tables: postings, document lengths, document frequencies.

Lucene's variant: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), tf part = tf / (tf + k1 (1 - b + b dl / avgdl)). Distinct
query terms count once. Scores are rounded to six digits before they are ordered, ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.tables import settled
from . import blockmax
from . import filters as fl

K1, B = 1.5, 0.75
#: Candidates per wanted row where a filter comes after the ranking.
OVERFETCH = 10

#: Distinct tokens of queries up to which an index that is made for them leaves out all others.
ONLY = 500_000

Analyzer = Callable[[Column], Column]


def analyzer(stopwords: list[str] | None = None, stem: Callable[[Column], Column] | None = None) -> Analyzer:
    """Terms of a text, less stopwords, stemmed."""

    def run(text: Column) -> Column:
        got = terms(text)
        got = F.filter(got, lambda t: ~t.isin(stopwords)) if stopwords else got
        return stem(got) if stem else got

    return run


@dataclass
class Index:
    """postings(token, id, tf, dl), documents(id, dl), tokens(token, df), corpus(n, avgdl)."""

    postings: DataFrame
    documents: DataFrame
    tokens: DataFrame
    corpus: DataFrame

    def save(self, path: str) -> None:
        for name in ("postings", "documents", "tokens", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "documents", "tokens", "corpus")))


def build(docs: DataFrame, id_col: str, text_col: str, analyze: Analyzer = terms, only: DataFrame | None = None) -> Index:
    """An index of every document; with only (a column token), postings and frequencies of those tokens alone.

    A document's tokens are counted in the task that reads it, so what is shuffled is a row for each distinct token; its
    length goes with them, so a search joins postings with query terms alone.
    """
    own = docs.select(F.col(id_col).alias("id"), analyze(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    sizes = own.select("id", F.size("tokens").cast("long").alias("dl"))
    each = own.select("id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("token"))
    if only is not None:
        each = each.join(only.select("token").distinct(), "token", "left_semi")
    postings = each.groupBy("id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    # of documents' distinct tokens, so that frequencies alone shuffle a row for each distinct token of a task
    distinct = own.select(F.explode(F.array_distinct("tokens")).alias("token"))
    if only is not None:
        distinct = distinct.join(only.select("token").distinct(), "token", "left_semi")
    tokens = distinct.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    corpus = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, sizes, tokens, corpus)


def query_terms(queries: DataFrame, query_id: str, text_col: str, analyze: Analyzer = terms) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(analyze(F.col(text_col)))).alias("token"))


def scores(index: Index, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id and score of every document that shares a token with the query."""
    weighted = wanted.join(index.tokens, "token").join(F.broadcast(index.corpus)).select(  # one row
        "query_id", "token", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    part = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return index.postings.join(weighted, "token").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best k of each query with rank from 1 and distance = -score."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "rank", (-F.col("score")).alias("distance"))


def searchable(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, analyze: Analyzer = terms, allowed: DataFrame | None = None) -> blockmax.Index:
    """Shards of the documents for the wanted tokens (all tokens, if those are too many); of those allowed, with the statistics of all."""
    names = [r["token"] for r in wanted.select("token").distinct().limit(ONLY + 1).collect()]
    only = names if len(names) <= ONLY else None
    shards = lambda own: settled(blockmax.shards(own, id_col, analyze(F.coalesce(F.col(text_col), F.lit(""))), only))
    built = blockmax.Index.of(shards(docs))
    return built if allowed is None else blockmax.Index(shards(allowed), built.tokens, built.corpus)


def shared(index: blockmax.Index, wanted: DataFrame, k: int) -> DataFrame:
    """The best k of each query by the share of its distinct terms that a document has, to six digits."""
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    both = blockmax.top_k(index, wanted, k, K1, B, counts=True).join(F.broadcast(size), "query_id")  # a row a query
    return ranked(both.select("query_id", "id", F.round(F.col("score") / F.col("terms"), 6).alias("score")), k)


def top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, query_id: str, query_col: str, where: dict | None = None, mode: str = "compat", analyze: Analyzer = terms, index: Index | blockmax.Index | None = None) -> DataFrame:
    """The best k documents of each query. compat: rank OVERFETCH * k, then filter, then cut; exact: filter, then rank.

    Statistics are those of the whole corpus either way. Without an index, shards with block bounds are made of the documents
    (of the queries' tokens alone, if these are few) and searched there.
    """
    wanted = query_terms(queries, query_id, query_col, analyze)
    n = k if where is None or mode == "exact" else OVERFETCH * k
    allowed = None if where is None else fl.apply(docs, where=where)
    if index is None:
        index = searchable(docs, wanted, id_col, text_col, analyze, allowed if mode == "exact" else None)
        scored = blockmax.top_k(index, wanted, n, K1, B)
    elif isinstance(index, blockmax.Index):
        if allowed is not None and mode == "exact":
            raise ValueError("an exact filter needs shards of what it allows")
        scored = blockmax.top_k(index, wanted, n, K1, B)
    else:
        scored = scores(index, wanted)
        if allowed is not None and mode == "exact":
            scored = scored.join(allowed.select(F.col(id_col).alias("id")), "id", "left_semi")
    if allowed is None or mode == "exact":
        return ranked(scored, k)
    kept = ranked(scored, n).join(allowed.select(F.col(id_col).alias("id")), "id", "left_semi")
    again = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k).select("query_id", "id", "rank", "distance")
