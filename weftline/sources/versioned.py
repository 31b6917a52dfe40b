"""Tables that are brought up to date by key: hash buckets that are copied when they are touched, and numbered versions.

A key's rows lie in the bucket of its hash. A batch reads and rewrites the buckets that its keys fall in and no others; a
version is one small file that names the folder of every bucket, and it is put in place in one step that fails if another
writer has made that version. So readers see one version whole, of two writers one wins and the other merges again on what
the first has made, and what a lost driver or executor leaves behind is never read.

A batch may carry a name: one that has been applied is not applied again. Versions stay readable until vacuum() drops them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Folder
from .tables import settled

#: Buckets of a new table: the least part of it that a batch rewrites, and the entries of a version's file.
BUCKETS = 64
#: The column of a row's bucket while it is written.
PART = "hash_bucket"
#: Names of applied batches that a version remembers; a batch is sent again soon or never.
REMEMBERED = 1000


class Conflict(RuntimeError):
    """Other writers were first, time and again."""


@dataclass
class Version:
    number: int
    schema: str
    key: str
    buckets: int
    folders: dict[str, str]
    applied: list[str]


class VersionedTable:
    """The table under path. key and buckets are those it was made with; given ones count for a new table."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, Folder(spark, path), key, buckets

    # ---------------------------------------------------------------- versions

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("versions")]

    def version(self, number: int | None = None) -> Version | None:
        """A version, the newest unless one is named; nothing if there is none."""
        known = self.numbers()
        if number is None and not known:
            return None
        got = self.folder.read(f"versions/{known[-1] if number is None else number:012d}.json")
        if got is None:
            raise ValueError(f"there is no version {number}; there are {known}")
        return Version(**got)

    def _next(self, base: Version | None, folders: dict[str, str], schema: str, batch: str | None) -> bool:
        applied = ((base.applied if base else []) + [batch] * (batch is not None))[-REMEMBERED:]
        number = base.number + 1 if base else 1
        new = Version(number, schema, self.key, base.buckets if base else self.buckets, folders, applied)
        return self.folder.claim(f"versions/{number:012d}.json", vars(new))

    # ---------------------------------------------------------------- reading

    def _rows(self, version: Version, buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.folder.path}/data/{f}/{PART}={b}" for b, f in sorted(version.folders.items()) if buckets is None or b in buckets]
        schema = T.StructType.fromJson(json.loads(version.schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version; the newest if none is named."""
        version = self.version(number)
        if version is None:
            raise ValueError(f"no table at {self.folder.path}")
        return self._rows(version)

    def lookup(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """Rows of the keys (a column of the key's name), from their buckets alone."""
        version = self.version(number)
        if version is None:
            raise ValueError(f"no table at {self.folder.path}")
        own = keys.select(self.key).distinct()
        return self._rows(version, self._touched(own, version.buckets)).join(own, self.key, "left_semi")

    # ---------------------------------------------------------------- writing

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _touched(self, rows: DataFrame, buckets: int) -> list[str]:
        """The buckets that have rows: as many as there are buckets at most."""
        return [str(r[0]) for r in rows.select(self._bucket(buckets)).distinct().collect()]

    def upsert(self, rows: DataFrame, order: str | None = None, batch: str | None = None, deleted: DataFrame | None = None) -> int:
        """Replace rows of known keys, add the others, and drop the keys of deleted. The version that has the batch.

        Of several rows of one key the greatest of order wins, or one of the greatest content hash. Columns that only one
        side has are null on the other. A named batch that has been applied changes nothing.
        """
        if PART in rows.columns:
            raise ValueError(f"{PART} is the name of the table's own column")
        by = [F.col(order).desc_nulls_last()] if order else []
        by.append(F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in rows.columns)))).desc())
        first = F.row_number().over(Window.partitionBy(self.key).orderBy(*by))
        fresh = settled(rows.withColumn(PART, first).where(F.col(PART) == 1).drop(PART))
        gone = settled(deleted.select(self.key).distinct()) if deleted is not None else None
        changed = fresh.select(self.key) if gone is None else fresh.select(self.key).union(gone)
        seen: dict[str, str | None] | None = None
        made: dict[str, str] = {}
        for _ in range(20):
            base = self.version()
            if base and batch is not None and batch in base.applied:
                return base.number
            touched = self._touched(changed, base.buckets if base else self.buckets)
            before = {b: (base.folders.get(b) if base else None) for b in touched}
            schema = self._merged_schema(base, fresh)
            if before != seen:  # else another writer has changed other buckets alone, and what is written stands
                for folder in set(made.values()):
                    self.folder.delete(f"data/{folder}")
                made, seen = self._write(base, fresh, gone, touched, schema), before
            folders = {b: f for b, f in (base.folders if base else {}).items() if b not in before} | made
            if self._next(base, folders, schema.json(), batch):
                return (base.number if base else 0) + 1
        raise Conflict(f"{self.folder.path}: twenty other versions came first")

    def delete(self, keys: DataFrame, batch: str | None = None) -> int:
        """Drop the rows of the keys."""
        base = self.version()
        if base is None:
            raise ValueError(f"no table at {self.folder.path}")
        none = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(base.schema)))
        return self.upsert(none, batch=batch, deleted=keys)

    def _merged_schema(self, base: Version | None, fresh: DataFrame) -> T.StructType:
        if base is None:
            return fresh.schema
        old = T.StructType.fromJson(json.loads(base.schema))
        known = {f.name: f.dataType for f in old}
        for f in fresh.schema:
            if f.name in known and known[f.name] != f.dataType:
                raise ValueError(f"{f.name} is {known[f.name].simpleString()} in the table and {f.dataType.simpleString()} in the batch")
        return T.StructType([*old, *(T.StructField(f.name, f.dataType) for f in fresh.schema if f.name not in known)])

    def _write(self, base: Version | None, fresh: DataFrame, gone: DataFrame | None, touched: list[str], schema: T.StructType) -> dict[str, str]:
        """Write the touched buckets anew: the folders of those that have rows afterwards."""
        if not touched:
            return {}
        buckets = base.buckets if base else self.buckets
        own = fresh.select(*(F.col(f.name) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        if base:
            old = self._rows(base, touched)
            old = old.select(*(F.col(f.name) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
            kept = fresh.select(self.key) if gone is None else fresh.select(self.key).union(gone)
            same = old.alias("o").join(kept.alias("n"), F.col(f"o.{self.key}").eqNullSafe(F.col(f"n.{self.key}")), "left_anti")
            own = own.unionByName(same)
        folder = uuid.uuid4().hex
        out = own.withColumn(PART, self._bucket(buckets))
        out.repartition(PART).write.partitionBy(PART).parquet(f"{self.folder.path}/data/{folder}")
        return {n.removeprefix(f"{PART}="): folder for n in self.folder.names(f"data/{folder}") if n.startswith(f"{PART}=")}

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all but the newest versions, and buckets that none of these names; for times without writers. What was dropped."""
        kept = self.numbers()[-max(1, keep) :]
        named = {f"{f}/{PART}={b}" for n in kept for b, f in self.version(n).folders.items()}
        for n in set(self.numbers()) - set(kept):
            self.folder.delete(f"versions/{n:012d}.json")
        whole = {f: [f"{f}/{b}" for b in self.folder.names(f"data/{f}") if b.startswith(PART)] for f in self.folder.names("data")}
        dropped = [x for f, own in whole.items() for x in ([b for b in own if b not in named] if named & set(own) else [f])]
        for x in dropped:
            self.folder.delete(f"data/{x}")
        self.folder.delete("_made")
        return dropped
