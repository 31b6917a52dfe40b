"""A keyword index that grows by segments: a batch writes its own segment and nothing else.

A segment is a set of shards (`operators.blockmax`) and is never changed. A document that a later batch replaces or deletes
is marked as gone by its shard and place. Frequencies of tokens are kept as differences, a table for each batch, and the
number of documents and their total length as two numbers in the version's file; so scores are those of an index that is
built anew, and no batch reads more of the older segments than their ids and the postings of shards that lose documents.
Segments of about one size are merged when there are enough of them, which leaves the documents that are gone behind.

A version is one small file that is put in place only if no other writer has made that version; a writer that comes second
starts again on what the first has made. A batch may carry a name, and then counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..operators import blockmax, bm25
from .files import Folder
from .versioned import REMEMBERED, Conflict

#: Segments of one tier that are merged into one, and how many times larger the next tier's segments are.
FAN, GROWTH = 4, 4
DIFFERENCES = "token string, df long"
GONE = "shard string, place int"


@dataclass
class State:
    """What a version's file says: segments by name with their documents, folders of gone documents and of differences, and totals."""

    number: int = 0
    segments: dict[str, int] = field(default_factory=dict)
    gone: list[str] = field(default_factory=list)
    differences: list[str] = field(default_factory=list)
    n: int = 0
    length: int = 0
    applied: list[str] = field(default_factory=list)


class SegmentedIndex:
    """The index under path. Ids are unique among live documents and not null."""

    def __init__(self, spark: SparkSession, path: str, analyze: Callable[[Column], Column] = terms):
        self.spark, self.folder, self.analyze = spark, Folder(spark, path), analyze

    def state(self) -> State:
        known = self.folder.names("versions")
        return State(**self.folder.read(f"versions/{known[-1]}")) if known else State()

    def _commit(self, state: State) -> bool:
        return self.folder.claim(f"versions/{state.number:012d}.json", asdict(state))

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _shards(self, names) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder.path}/segments/{n}" for n in names))

    def _live(self, state: State) -> DataFrame:
        """shard, place, id and length of the documents that are not gone."""
        heads = self._shards(state.segments).where("token IS NULL")
        each = heads.select("shard", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "x")).select("shard", "place", F.col("x.ids").alias("id"), F.col("x.lengths").alias("length"))
        gone = self._read(state.gone, GONE)
        return each.join(gone, ["shard", "place"], "left_anti") if state.gone else each

    # ---------------------------------------------------------------- writing

    def apply(self, docs: DataFrame | None = None, id_col: str = "id", text_col: str = "text", deleted: DataFrame | None = None, batch: str | None = None) -> int:
        """Add documents, replacing those of the same ids, and drop those whose ids deleted (of the same column) has. The version.

        Of several rows of one id one is kept, by content; rows without an id are refused.
        """
        name = f"s{uuid.uuid4().hex}"
        ids = self._segment(name, docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))) if docs is not None else None
        if deleted is not None:
            gone = deleted.select(F.col(id_col).alias("id"))
            ids = gone if ids is None else ids.union(gone)
        for _ in range(20):
            state = self.state()
            if batch is not None and batch in state.applied:
                self.folder.delete(f"segments/{name}")
                return state.number
            new = State(state.number + 1, dict(state.segments), list(state.gone), list(state.differences), state.n, state.length, (state.applied + [batch] * (batch is not None))[-REMEMBERED:])
            changes = [f"gone/{uuid.uuid4().hex}", f"differences/{uuid.uuid4().hex}"]
            minus = self._lose(state, new, ids, changes[0]) if state.segments else None
            plus = self._gain(new, name) if docs is not None else None
            parts = [x for x in (minus, plus) if x is not None]
            if parts:
                both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
                both.groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{self.folder.path}/{changes[1]}")
                new.differences.append(changes[1])
            if self._commit(new):
                return new.number
            for made in changes:  # another writer was first: what is gone is to be looked up anew
                self.folder.delete(made)
        raise Conflict(f"{self.folder.path}: twenty other versions came first")

    def _segment(self, name: str, docs: DataFrame) -> DataFrame:
        """Write the segment of docs(id, text) and return its ids.

        Documents are read once and not dealt out; only if the segment then has an id twice it is written again, of one row an id.
        """
        folder = f"segments/{name}"
        write = lambda own: blockmax.shards(own, "id", self.analyze(F.col("text")), prefix=f"{name}-").write.parquet(f"{self.folder.path}/{folder}")
        ids = lambda: self._shards([name]).where("token IS NULL").select(F.explode("ids").alias("id"))
        write(docs)
        bad, twice = ids().groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("id").isNull()), F.count_if(F.col("n") > 1)).first()
        if bad or twice:
            self.folder.delete(folder)
        if bad:
            raise ValueError("documents without an id")
        if twice:
            one = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text").desc()))
            write(docs.withColumn("one", one).where("one = 1").drop("one"))
        return ids()

    def _gain(self, new: State, name: str) -> DataFrame | None:
        """Count the new segment in; its tokens' frequencies."""
        shards = self._shards([name])
        n, length = shards.where("token IS NULL").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
        if not n:
            return None
        new.segments[name] = n
        new.n, new.length = new.n + n, new.length + length
        return blockmax.tokens(shards).select("token", F.col("df").cast("long").alias("df"))

    def _lose(self, state: State, new: State, ids: DataFrame, folder: str) -> DataFrame | None:
        """Mark live documents of the ids as gone; what the frequencies of their tokens lose."""
        self._live(state).join(ids.distinct(), "id", "left_semi").write.parquet(f"{self.folder.path}/{folder}")
        lost = self.spark.read.parquet(f"{self.folder.path}/{folder}")
        n, length = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not n:
            self.folder.delete(folder)
            return None
        new.gone.append(folder)
        new.n, new.length = new.n - n, new.length - length
        return blockmax.lost(self._shards(state.segments), lost).select("token", (-F.col("df")).alias("df"))

    # ---------------------------------------------------------------- searching

    def index(self) -> blockmax.Index:
        """The newest version as an index to be searched."""
        state = self.state()
        if not state.segments:
            raise ValueError(f"no index at {self.folder.path}")
        df = self._read(state.differences, DIFFERENCES).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        corpus = self.spark.range(1).select(F.lit(state.n).cast("long").alias("n"), F.lit(state.length / state.n if state.n else None).cast("double").alias("avgdl"))
        return blockmax.Index(self._shards(state.segments), df, corpus, self._read(state.gone, GONE) if state.gone else None)

    def top_k(self, queries: DataFrame, k: int, query_id: str, query_col: str) -> DataFrame:
        """query_id, id, rank and distance of each query's best k live documents."""
        wanted = bm25.query_terms(queries, query_id, query_col, self.analyze)
        return bm25.ranked(blockmax.top_k(self.index(), wanted, k, bm25.K1, bm25.B), k)

    # ---------------------------------------------------------------- merging

    @staticmethod
    def _tier(docs: int) -> int:
        tier = 0
        while docs >= GROWTH:
            docs, tier = docs // GROWTH, tier + 1
        return tier

    def due(self) -> list[str]:
        """The segments of the smallest tier that has enough of them."""
        tiers: dict[int, list[str]] = {}
        for name, docs in self.state().segments.items():
            tiers.setdefault(self._tier(docs), []).append(name)
        return next((own for _, own in sorted(tiers.items()) if len(own) >= FAN), [])

    def merge(self, names: list[str] | None = None) -> bool:
        """Write one segment in place of those due (or named), without what is gone, and the differences as one table. False if none is due or another writer was first."""
        state, names = self.state(), names or self.due()
        if not names:
            return False
        name, folder = f"m{uuid.uuid4().hex}", f"differences/{uuid.uuid4().hex}"
        blockmax.merge(self._shards(names), self._read(state.gone, GONE) if state.gone else None, f"{name}-").write.parquet(f"{self.folder.path}/segments/{name}")
        self._read(state.differences, DIFFERENCES).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{self.folder.path}/{folder}")
        kept = {n: d for n, d in state.segments.items() if n not in names}
        n = self._shards([name]).where("token IS NULL").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
        gone = []
        if state.gone and kept:  # those of the segments that stay
            gone = [f"gone/{uuid.uuid4().hex}"]
            own = self._shards(kept).where("token IS NULL").select("shard")
            self._read(state.gone, GONE).join(own, "shard", "left_semi").write.parquet(f"{self.folder.path}/{gone[0]}")
        return self._commit(State(state.number + 1, kept | ({name: n} if n else {}), gone, [folder], state.n, state.length, state.applied))
