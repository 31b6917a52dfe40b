"""Answer spans in documents, and the chunks that they make relevant."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import overlap
from . import anchors
from .intervals import overlap_join

#: Characters of all needles that are shipped to executors at once.
NEEDLE_CHARS = 32 << 20


def find_spans(docs: DataFrame, needles: DataFrame, id_col: str, text_col: str, needle_id: str, needle_col: str, first: bool = False) -> DataFrame:
    """needle_id, id, start and end of every place of every needle in every document; with first only its first place.

    Ids keep their types. Needles of one block are found in one pass over a text by an automaton. Of more than a block those
    that are long enough are looked up by rare grams instead, and the short ones in blocks, which bound what is shipped.
    """
    total = int(needles.agg(F.coalesce(F.sum(F.length(needle_col)), F.lit(0))).first()[0])
    if total <= NEEDLE_CHARS:
        return automaton_spans(docs, needles, id_col, text_col, needle_id, needle_col, first)
    short = needles.where(F.length(needle_col) < anchors.SHORTEST)
    names = (id_col, text_col, needle_id, needle_col, first)
    return anchors.find_spans(docs, needles, *names).unionByName(automaton_spans(docs, short, *names))


def automaton_spans(docs: DataFrame, needles: DataFrame, id_col: str, text_col: str, needle_id: str, needle_col: str, first: bool = False) -> DataFrame:
    """find_spans by an automaton of each block of needles."""
    spark = docs.sparkSession
    given = needles.where(F.length(needle_col) > 0).select(F.col(needle_id).alias("needle_id"), F.col(needle_col).alias("needle"))
    blocks = max(1, -(-int(given.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0]) // NEEDLE_CHARS))
    schema = T.StructType([T.StructField("needle_id", needles.schema[needle_id].dataType), T.StructField("id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    out = None
    for part in range(blocks):
        own = given if blocks == 1 else given.where(F.pmod(F.xxhash64("needle_id"), F.lit(blocks)) == part)
        table: dict[str, list] = {}
        for key, needle in own.collect():  # at most about NEEDLE_CHARS characters
            table.setdefault(needle, []).append(key)
        shipped = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for needle, keys in shipped.value.items():
                automaton.add_word(needle, (keys, len(needle)))
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen = set()
                    for last, (keys, size) in automaton.iter(text or "") if len(automaton) else ():
                        for k in keys:
                            if not first or k not in seen:
                                seen.add(k)
                                rows.append((k, key, last + 1 - size, last + 1))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["needle_id", "id", "start", "end"])

        found = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def disambiguate(spans: DataFrame, texts: DataFrame, prefix: str | None = None, suffix: str | None = None, occurrence: int | None = None) -> DataFrame:
    """Places with the given text before and after them; of these, with occurrence, the one of that number from 1."""
    from pyspark.sql import Window

    own = spans.join(texts.select("id", "text"), "id")
    if prefix:
        own = own.where(F.endswith(F.substring(F.col("text"), F.lit(1), F.col("start").cast("int")), F.lit(prefix)))
    if suffix:
        own = own.where(F.startswith(F.substring(F.col("text"), (F.col("end") + 1).cast("int"), F.lit(len(suffix))), F.lit(suffix)))
    own = own.drop("text")
    if occurrence:
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy("needle_id", "id").orderBy("start"))).where(F.col("_n") == occurrence).drop("_n")
    return own


def map_to_chunks(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, overlap_chars, overlap_score and answer_chars.

    targets(query_id, target_idx, document_id, start, end), chunks(chunk_id, document_id, chunk_index, start, end). Every
    target counts for the answer's length, also one that no chunk meets; overlaps add up over targets.
    """
    length = targets.groupBy("query_id").agg(F.sum(F.col("end") - F.col("start")).alias("answer_chars"))
    c = chunks.select("chunk_id", "document_id", "chunk_index", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    shared = overlap("start", "end", "c_start", "c_end").cast("long")
    own = targets.select("query_id", "target_idx", "document_id", "start", "end")
    met = overlap_join(own, c, "document_id", ("start", "end"), ("c_start", "c_end")).groupBy("query_id", "chunk_id").agg(F.sum(shared).alias("overlap_chars"), F.min(F.struct("target_idx", "chunk_index")).alias("touched"))
    return met.join(length, "query_id").withColumn("overlap_score", F.round(F.col("overlap_chars") / F.col("answer_chars"), 6))


def validate_targets(targets: DataFrame, documents: DataFrame) -> DataFrame:
    """Targets with an error: no such document, bounds out of order or outside the text, or a blank extract; null if sound."""
    own = targets.join(documents.select("document_id", "text"), "document_id", "left")
    extract = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    error = (
        F.when(F.col("text").isNull(), "unknown document").when((F.col("start") < 0) | (F.col("start") >= F.col("end")), "bad bounds")
        .when(F.col("end") > F.length("text"), "beyond the text").when(F.regexp_replace(extract, r"(?U)\s", "") == "", "blank extract")
    )
    return own.withColumn("error", error).drop("text")
