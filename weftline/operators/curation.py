"""Golden sets: from annotations to checked rows with offsets and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, preview, query_key
from ..sources.tables import settled

ENTRY_KEYS = ["query", "targets", "expected_answer_points"]


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return first_by(df.withColumn("_o", -F.col(order)), key, "_o").drop("_o")


def sequential_ids(df: DataFrame, order: str, offset: int = 0) -> DataFrame:
    """query_id of five digits or more, counting from offset + 1 in order: ranges of the order are counted first, then rows within.

    The ranges are written once, so that both counts see the same ones. The offsets of at most as many ranges as there are
    shuffle partitions come to the driver.
    """
    ranged = settled(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before, total = {}, offset
    for part, n in counts:
        before[part], total = total, total + n
    if not before:
        return df.withColumn("query_id", F.lit("").cast("string"))
    start = F.get(F.lit([before.get(p, 0) for p in range(max(before) + 1)]), F.col("_part"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("query_id", F.format_string("%05d", (start + n).cast("long"))).drop("_part")


def complete(annotations: DataFrame, manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Targets by URL with their document and the offsets of the span's first place; error where there is no such page or span.

    annotations(query, target_idx, relevant_url, relevant_span), manifest(source_url, document_id, pos), texts(document_id, text).
    """
    known = first_by(manifest, "source_url", "pos").select(F.col("source_url").alias("relevant_url"), "document_id")
    own = annotations.join(known, "relevant_url", "left").join(texts, "document_id", "left")
    at = F.call_function("instr", F.col("text"), F.col("relevant_span"))
    start = F.when(at > 0, (at - 1).cast("long"))
    error = F.when(F.col("document_id").isNull(), "unknown page").when(F.col("text").isNull(), "no text").when(at == 0, "span not found")
    return own.withColumn("start", start).withColumn("end", start + F.length("relevant_span")).withColumn("error", error).drop("text")


def extract(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def duplicate_queries(entries: DataFrame, col: str = "query") -> DataFrame:
    """Keys that several entries share, and how many."""
    return entries.groupBy(query_key(col).alias("query_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_entries(raw: DataFrame, col: str = "value") -> DataFrame:
    """JSON entries with their error: keys other than the three, an empty query, no targets, or a blank answer point; null if sound."""
    entry = F.from_json(F.col(col), "query string, targets array<struct<document_path:string,char_span:array<int>>>, expected_answer_points array<string>")
    blank = lambda x: F.coalesce(collapse(x), F.lit("")) == ""
    error = (
        F.when(F.json_object_keys(F.col(col)).isNull(), "not an object")
        .when(F.array_sort(F.json_object_keys(F.col(col))) != F.array(*map(F.lit, sorted(ENTRY_KEYS))), "wrong keys")
        .when(blank(entry["query"]), "empty query")
        .when(F.coalesce(F.size(entry["targets"]), F.lit(0)) < 1, "no targets")
        .when(F.coalesce(F.size(entry["expected_answer_points"]), F.lit(0)) < 1, "no answer points")
        .when(F.exists(entry["expected_answer_points"], blank), "blank answer point")
        .when(F.exists(entry["targets"], lambda t: (F.size(t["char_span"]) != 2) | blank(t["document_path"]) | (F.get(t["char_span"], F.lit(0)) < 0) | (F.get(t["char_span"], F.lit(0)) >= F.get(t["char_span"], F.lit(1)))), "bad target")
    )
    return raw.withColumn("entry", entry).withColumn("error", error)


def previews(targets: DataFrame, texts: DataFrame) -> DataFrame:
    """Targets with one line of what they span."""
    own = targets.join(texts, "document_id")
    return own.withColumn("preview", preview(extract(F.col("text"), F.col("start"), F.col("end")))).drop("text")


def format_approved(annotated: DataFrame, manifest: DataFrame, texts: DataFrame, last: int = 0) -> DataFrame:
    """Approved candidates as golden rows, numbered from last + 1 in the order of pos: targets by document path, with the text that their spans hold.

    annotated(pos, query, targets, expected_answer_points), a target being document_path and char_span; manifest(
    processed_file_path, source_url, document_id, pos), of which the first row of a path counts; texts(document_path, text).
    A target whose path is unknown has no document and no text.
    """
    known = first_by(manifest, "processed_file_path", "pos").select(F.col("processed_file_path").alias("document_path"), "source_url", "document_id")
    each = annotated.select("pos", F.posexplode("targets").alias("n", "target")).select("pos", "n", "target.*").join(known, "document_path", "left").join(texts, "document_path", "left")
    span = extract(F.col("text"), F.get("char_span", F.lit(0)), F.get("char_span", F.lit(1)))
    made = F.struct("document_id", "document_path", span.alias("relevant_span"), F.col("source_url").alias("relevant_url"), "char_span")
    targets = each.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", made.alias("target")))), lambda x: x["target"]).alias("targets"))
    rows = annotated.drop("targets").join(targets, "pos", "left")
    return sequential_ids(rows, "pos", last).select("query_id", "query", F.lit("general").alias("query_type"), F.lit("easy").alias("answer_type"), "targets", "expected_answer_points")


def seeded(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows in an order that a seed and the keys decide: the same rows on every run. This is a sampling operator."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
