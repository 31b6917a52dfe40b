"""Places of very many needles in texts, by rare grams that both have: no task sees all needles.

A text's marks are the grams that are least, by a hash, among some run of `WINDOW` grams; a needle long enough to hold such a run
has a mark wherever it occurs, at the same place in it. A needle is looked up by the rarest of its marks. Of the texts' marks
only those leave a task whose hash is set in a bitmap of the needles' marks, which has a fixed size; candidates are then
compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import settled

#: Characters of a gram, grams of a run; the shortest needle that is sure to have a mark.
GRAM, WINDOW = 12, 16
SHORTEST = GRAM + WINDOW - 1
#: Bits of the bitmap by which texts' marks are held against needles' marks: 16 MB.
BITS = 1 << 27


def marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's marks and their hashes, as signed numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(1) + np.arange(n - WINDOW + 1)
    places = least[np.flatnonzero(np.diff(least, prepend=-1))]  # they never go back
    return places, grams[places].view(np.int64)


def _marked(df: DataFrame, text: str, kept: list[str], bits: bytes | None = None) -> DataFrame:
    """The kept columns with hash and place of every mark of the text; with bits only marks that are set there."""
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("hash", T.LongType()), T.StructField("place", T.LongType())])
    shipped = df.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shipped.value, np.uint8) if shipped else None
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                rows, places, hashes = [], [], []
                for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    at, of = marks(text or "")
                    if wanted is not None:
                        bit = of & (BITS - 1)
                        at, of = (x[(wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) > 0] for x in (at, of))
                    rows.append(np.full(len(at), k))
                    places.append(at)
                    hashes.append(of)
                own = batch.take(pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(np.concatenate([np.zeros(0, np.int64), *hashes])), pa.array(np.concatenate([np.zeros(0, np.int64), *places]))], schema.names)

    return df.select(*kept, text).mapInArrow(run, schema)


def bitmap(hashes: DataFrame) -> bytes:
    """The bits of a table's hashes: pieces of 4096 bytes, as many as there are at most in BITS."""
    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1)) + 1  # Spark's bitmaps number their bits from 1 on
    pieces = hashes.groupBy(F.bitmap_bucket_number(bit).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = bytearray(BITS // 8)
    for piece, bits in pieces.collect():
        out[(piece - 1) * 4096 : piece * 4096] = bytes(bits)
    return bytes(out)


def find_spans(docs: DataFrame, needles: DataFrame, id_col: str, text_col: str, needle_id: str, needle_col: str, first: bool = False) -> DataFrame:
    """needle_id, id, start and end of every place of needles of SHORTEST characters and more; with first only the first place in a text."""
    own = needles.where(F.length(needle_col) >= SHORTEST).select(F.col(needle_id).alias("needle_id"), F.col(needle_col).alias("needle"))
    own = own.withColumn("of", F.xxhash64("needle"))
    texts = docs.where(F.length(text_col) >= SHORTEST).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("key"), "text")  # rows of one id and one text have the same places
    asked = settled(_marked(own.select("of", "needle").dropDuplicates(["of", "needle"]), "needle", ["of"]).withColumnRenamed("place", "offset"))
    met = _marked(texts, "text", ["id", "key"], bitmap(asked))
    hits = settled(met.join(asked.select("hash").distinct(), "hash", "left_semi"))
    seen = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    # a needle of which a mark is nowhere is nowhere; of the others the rarest mark counts, at its first place in the needle
    rarest = asked.join(seen, "hash", "left").groupBy("of").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "offset")).alias("m")).where("m.n > 0")
    looked = rarest.select("of", F.col("m.hash").alias("hash"), F.col("m.offset").alias("offset"))
    spots = hits.join(looked, "hash").select("id", "key", "of", (F.col("place") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    wanted = spots.join(own, "of")
    same = texts.alias("t").join(wanted.alias("w"), (F.col("t.key") == F.col("w.key")) & F.col("t.id").eqNullSafe(F.col("w.id")))
    size = F.length("w.needle")
    found = same.where(F.substring(F.col("t.text"), F.col("w.start").cast("int") + 1, size) == F.col("w.needle"))
    out = found.select("w.needle_id", "t.id", "t.key", F.col("w.start").alias("start"), (F.col("w.start") + size).alias("end"))
    if first:
        least = F.min("start").over(Window.partitionBy("needle_id", "id", "key"))
        out = out.withColumn("least", least).where("start = least")
    return out.select("needle_id", "id", "start", "end")
