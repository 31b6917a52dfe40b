"""Retrieval metrics as relational algebra: qrels(query_id, id), results(query_id, id, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_QUERY = ["reciprocal_rank", "precision_at_k", "recall_at_k", "average_precision_at_k", "ndcg_at_k"]
METRICS = ["hit_rate_at_k", "recall_at_k", "precision_at_k", "mrr_at_k", "map_at_k", "ndcg_at_k"]


def cutoffs(ks: list[int]) -> list[int]:
    if not ks or any(k <= 0 for k in ks):
        raise ValueError("cutoffs must be given and positive")
    return sorted(set(ks))


def stabilize_ties(results: DataFrame) -> DataFrame:
    """Within each stretch of neighbouring equal distances, order by id; stretches stay where they are."""
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    change = F.when(F.col("distance").eqNullSafe(F.lag("distance").over(by_rank)) & (F.row_number().over(by_rank) > 1), 0).otherwise(1)
    marked = results.withColumn("_change", change)
    island = marked.withColumn("_island", F.sum("_change").over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_island", "id"))).drop("_change", "_island")


def per_query(results: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """For each query with a relevant id and each cutoff: counts, first relevant rank and the six metrics' parts.

    One pass over the ranked rows: the number of relevant ones so far is a running sum, each cutoff a conditional sum.
    A query without results has zeros.
    """
    relevant = qrels.select("query_id", "id").distinct()
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_relevant"))
    top = max(cutoffs(ks))
    own = results.where(F.col("rank") <= top).select("query_id", "id", "rank").join(relevant.withColumn("rel", F.lit(1)), ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    seen = own.withColumn("seen", F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.col("rel") == 1
    sums = []
    for k in cutoffs(ks):
        at = hit & (F.col("rank") <= k)
        sums.append(F.struct(
            F.lit(k).alias("k"), F.count_if(at).alias("found"), F.min(F.when(at, F.col("rank"))).alias("first_relevant_rank"),
            F.coalesce(F.sum(F.when(at, F.col("seen") / F.col("rank"))), F.lit(0.0)).alias("precisions"), F.coalesce(F.sum(F.when(at, 1 / F.log2(F.col("rank") + F.lit(1.0)))), F.lit(0.0)).alias("gain"),
        ))
    counted = seen.groupBy("query_id").agg(F.array(*sums).alias("cuts"))
    none = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("found"), F.lit(None).cast("int").alias("first_relevant_rank"), F.lit(0.0).alias("precisions"), F.lit(0.0).alias("gain")) for k in cutoffs(ks)))
    rows = wanted.join(counted, "query_id", "left").select("query_id", "num_relevant", F.inline(F.coalesce("cuts", none)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("num_relevant", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    return rows.select(
        "query_id", "k", "num_relevant", (F.col("found") > 0).alias("hit"), "first_relevant_rank", F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("found") / F.col("k")).alias("precision_at_k"), (F.col("found") / F.col("num_relevant")).alias("recall_at_k"),
        (F.col("precisions") / F.least("num_relevant", "k")).alias("average_precision_at_k"), (F.col("gain") / ideal).alias("ndcg_at_k"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Averages of per_query rows by cutoff."""
    six = lambda x, name: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias(name)
    return rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_queries"), six(F.col("hit").cast("double"), "hit_rate_at_k"), six("recall_at_k", "recall_at_k"), six("precision_at_k", "precision_at_k"),
        six("reciprocal_rank", "mrr_at_k"), six("average_precision_at_k", "map_at_k"), six("ndcg_at_k", "ndcg_at_k"),
    )


def long_form(runs: dict[str, DataFrame]) -> DataFrame:
    """label, k, metric and value of several summaries."""
    out = None
    for label, df in runs.items():
        one = df.select(F.lit(label).alias("label"), "k", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))))
        out = one if out is None else out.unionByName(one)
    return out


def common_metrics(runs: DataFrame) -> DataFrame:
    """Metrics that every run has."""
    n = runs.select("label").distinct().count()
    return runs.groupBy("metric").agg(F.countDistinct("label").alias("n_runs")).where(F.col("n_runs") == n).select("metric")


def unique_labels(labels: DataFrame) -> DataFrame:
    """label with the number of its occurrence where it occurs more than once; order by pos."""
    same = Window.partitionBy("label")
    n = F.row_number().over(same.orderBy("pos"))
    return labels.withColumn("unique_label", F.when(F.count(F.lit(1)).over(same) > 1, F.concat(F.col("label"), F.lit(" #"), n.cast("string"))).otherwise(F.col("label")))


def all_cutoffs(runs: DataFrame) -> DataFrame:
    """Cutoffs that any run has, and in how many runs."""
    return runs.groupBy("k").agg(F.countDistinct("label").alias("n_runs"))


def level_values(paths: DataFrame, col: str) -> DataFrame:
    """Of paths (arrays): for each level from 0 the number of rows that reach it, of different values there, and of rows that end there."""
    each = paths.where(F.size(col) > 0).select(F.size(col).alias("depth"), F.posexplode(col).alias("level", "value"))
    return each.groupBy("level").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("value").alias("n_values"), F.count_if(F.col("depth") == F.col("level") + 1).alias("n_deepest"))
