r"""Mixing sources to target weights by capped water-filling.

A source's size is its words. The mix shares a number of words among the sources by weight; no source may be taken more
than a maximum of epochs. Clamping the sources above their cap and sharing the excess among the others, until none is
above, ends at one water level: a source gets the lesser of its cap and level x weight. In ascending order of
cap / weight, the level is the largest of (what the caps before leave) / (the weights from here on), so running sums over
the sources give it. A document is then taken as often as its source's target has whole epochs; for the rest of the
target, documents are taken once more in the order of a seeded digest of their id, the last one if at least half of it
fits. Column functions only; documents are ordered in ranges, so a source may hold any share of them.

Defined results: a null text has no words; null is a source of its own, after all others; sources without words have
target 0; repeated rows are documents of their own (which of equal ones is repeated does not show); a very long text is
counted whole and is taken whole or not at all, so a source misses its target by half of one document at most; extra
columns of any name pass through `mix` unless they are named like its results; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import running
from . import shared as S

#: The weights, repeating over the sources in order; the words of the mix in parts of all words; the most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
SEED = "mix-1"
#: Bytes of source names up to which the sources' table is broadcast; beyond it the join shuffles.
SHIPPED = 4 << 20
ADDED = ["size", "source_size", "target", "taken"]


def words(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, source_before (words of all sources before it in the order) and target, from a table of source and size."""
    sums = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    by_name = running.ordered(sums, [F.col("source").isNull(), F.col("source")], "sources")
    named = running.summed(by_name, {"source_before": "source_size"}).alias("a").join(running.placed(by_name, "place").select("source", "place").alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int"))
    own = named.select("a.source", "source_size", "source_before", weight.cast("long").alias("weight"), (F.lit(epochs) * F.col("source_size")).alias("cap"))
    filled = running.summed(running.ordered(own, [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")], "fill"), {"caps_before": "cap", "weights_before": "weight"})
    total = filled.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = filled.crossJoin(F.broadcast(total)).agg(F.max((share * F.col("all_size") - F.col("caps_before")) / (F.col("all_weight") - F.col("weights_before"))).alias("level"))
    return filled.crossJoin(F.broadcast(level)).select("source", "source_size", "source_before", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """docs without the text, with size, source_size, target (its source's) and taken: the words that the mix takes of it."""
    names = [c for c in S.others(docs, *ADDED) if c.lower() != text.lower()]
    used = [*names, *ADDED]
    key, order, own, before = S.apart(used, "source_key", "order", "size_", "before")
    counted = S.cut(docs.select(*map(S.quoted, names), words(S.quoted(text)).alias(own)), "sizes")
    per_source = S.cut(targets(counted.select(S.quoted(source).alias("source"), F.col(own).alias("size")), **how), "targets")
    sorted_docs = counted.withColumn(order, F.md5(F.concat(F.lit(seed + ":"), F.coalesce(S.quoted(id_col).cast("string"), F.lit(""))).cast("binary")))
    by = [S.quoted(source).isNull(), S.quoted(source), F.col(order), S.quoted(id_col), F.col(own)]
    (at,) = S.apart([*used, key, order, own, before], "at")
    summed = running.summed(running.ordered(sorted_docs, by, "mixed", at), {before: own}, at)
    held = per_source.agg(F.coalesce(F.sum(F.octet_length("source") + 32), F.lit(0))).first()[0]
    table = per_source.select(F.col("source").alias(key), F.col("source_size").alias("of_size"), F.col("source_before").alias("of_before"), F.col("target").alias("of_target"))
    met = summed.alias("d").join((F.broadcast(table) if held <= SHIPPED else table).alias("s"), F.col(f"d.`{source}`").eqNullSafe(F.col(f"s.{key}")))
    whole = F.when(F.col("of_size") > 0, F.floor(F.col("of_target") / F.col("of_size"))).otherwise(0)
    inside = F.col(before) - F.col("of_before")
    more = 2 * inside + F.col(own) <= 2 * (F.col("of_target") - whole * F.col("of_size"))
    taken = (whole * F.col(own) + F.when(more, F.col(own)).otherwise(0)).cast("long")
    return met.select(*(F.col("d.`" + c.replace("`", "``") + "`") for c in names), F.col(own).alias("size"), F.col("of_size").alias("source_size"), F.col("of_target").alias("target"), taken.alias("taken"))


def op13(spark, sf_dir: str) -> DataFrame:
    got = mix(S.documents(spark, sf_dir).select("doc_id", "source", "text"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


#: The level by one pass over the sources, the order of documents by a window.
SQL = r"""
WITH own AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM own GROUP BY source),
caps AS (SELECT source, source_size, 2 * source_size AS cap, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM per),
steps AS (SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM caps)::DOUBLE - coalesce(sum(b.cap), 0)::DOUBLE) / ((SELECT sum(weight) FROM caps) - coalesce(sum(b.weight), 0))::DOUBLE AS level
          FROM caps AS a LEFT JOIN caps AS b ON b.cap * a.weight < a.cap * b.weight GROUP BY a.source),
goals AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM steps) * weight) AS target FROM caps),
runs AS (SELECT own.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY own.source ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
         FROM own JOIN goals ON own.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN size ELSE 0 END)::BIGINT AS taken FROM runs
"""
