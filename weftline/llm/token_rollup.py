"""Token counts as delta-maintained rollups.

Every change to a document is a signed row: an insert adds its count, a delete takes it away, a revised count takes the
old one away and adds the new one. A batch of changes becomes a small table of additive totals by source, language and
tokenizer version. It is written to a folder of its own first; what commits it is one small file, named after the batch,
that is moved into place only if no such file is there, and that names the folder and a digest of its rows. So of two
writers of a batch one wins whole, a batch that is sent again counts once, one that is sent again with other rows is
refused, and what a lost driver or executor has left behind is never read. Totals are the sum of the committed batches;
compact() replaces those by one snapshot, so that totals read one table and the batches since. The snapshot's digests are a
table too. A reader looks at the batches first and at the newest snapshot after them: a batch that a compaction has taken
away meanwhile is then in that snapshot, and one that is in both counts once. All of this needs a file system whose rename
fails where its target exists, in one step; object stores without such a rename would need a lock of their own.

Defined results: null source or language is a group of its own; a null text has no tokens; repeated rows count each; a
very long text is counted whole; columns other than those named are ignored; groups whose documents and tokens have both
come to zero are left out; no change at all gives an empty rollup.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

GROUP = ["source", "lang", "tokenizer"]
DIGESTS = "batch string, digest string"
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def insert(docs: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.col(tokens).cast("long").alias("n_tokens"))


def delete(docs: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(-1).cast("long").alias("n_docs"), (-F.col(tokens)).cast("long").alias("n_tokens"))


def revise(docs: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """A revised count in one row: documents stay, tokens change by the difference."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), (F.col(new) - F.col(old)).cast("long").alias("n_tokens"))


class Rollup:
    """The rollup kept under path, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        """The JSON of a small file, or nothing if it is not there or goes meanwhile."""
        fs, at = self._fs(), self._at(name)
        try:
            src = fs.open(at)
        except Py4JJavaError as error:
            if fs.exists(at):
                raise error
            return None
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(src)))
        finally:
            src.close()

    def _claim(self, name: str, content: dict) -> bool:
        """Put a whole file in place unless one is there: the move fails where its target exists."""
        jvm, fs, made = self.spark._jvm, self._fs(), self._at(f"attempts/{uuid.uuid4().hex}.json")
        out = fs.create(made, False)
        out.write(json.dumps(content).encode())
        out.close()
        fs.mkdirs(self._at(name).getParent())
        try:
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, self._at(name), none)
            return True
        except Py4JJavaError as error:
            if not fs.exists(self._at(name)):
                raise error
            fs.delete(made, False)
            return False

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return sorted(x.getPath().getName().removesuffix(".json") for x in fs.listStatus(at)) if fs.exists(at) else []

    def _snapshot(self) -> tuple[int, dict]:
        """The number and content of the newest snapshot: the folders of its totals and of its batches' digests."""
        found = self._names("snapshots")
        return (int(found[-1]), self._read(f"snapshots/{found[-1]}.json")) if found else (0, {"folder": None, "digests": None})

    def _digests(self, snapshot: dict) -> DataFrame:
        """batch and digest of the batches in a snapshot."""
        at = snapshot["digests"]
        return self.spark.read.schema(DIGESTS).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], DIGESTS)

    def _digest(self, batch: str) -> str | None:
        """The digest of a batch in the newest snapshot."""
        snapshot = self._snapshot()[1]
        found = self._digests(snapshot).where(F.col("batch") == batch).first() if snapshot["digests"] else None
        return found and found["digest"]

    def batches(self) -> list[str]:
        """Ids of the committed batches, for inspection: all of them come to the driver."""
        since = self._names("batches")
        return sorted({*(r["batch"] for r in self._digests(self._snapshot()[1]).collect()), *since})

    def _write(self, summed: DataFrame) -> str:
        folder = f"attempts/{uuid.uuid4().hex}"
        summed.coalesce(1).write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch of signed rows; False, and no change, if it has been applied before; ValueError if that was with other rows."""
        folder = self._write(deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens")))
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{folder}")
        digest = str(rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()[0])
        before = self._digest(batch)
        if before is None and self._claim(f"batches/{batch}.json", {"folder": folder, "digest": digest}):
            before = self._digest(batch)
            if before is None:
                return True
            self._fs().delete(self._at(f"batches/{batch}.json"), False)  # compacted between the look and the claim
        self._fs().delete(self._at(folder), True)
        before = before or (self._read(f"batches/{batch}.json") or {}).get("digest") or self._digest(batch)
        if before != digest:
            raise ValueError(f"batch {batch!r} has been committed with other rows")
        return False

    def _committed(self) -> tuple[int, dict, dict[str, dict]]:
        """The newest snapshot's number and content, and the committed batches that it does not have (as many as came since)."""
        while True:
            named = {name: self._read(f"batches/{name}.json") for name in self._names("batches")}
            number, snapshot = self._snapshot()
            known = {r["batch"] for r in self._digests(snapshot).where(F.col("batch").isin(list(named))).collect()} if named and snapshot["digests"] else set()
            since = {name: x for name, x in named.items() if name not in known}
            if all(since.values()):  # a batch's file only goes when a snapshot has it; else a newer one is there by now
                return number, snapshot, since

    def _rows(self, snapshot: dict, since: dict[str, dict]) -> DataFrame | None:
        folders = [f"{self.path}/{x}" for x in [snapshot["folder"], *(x["folder"] for x in since.values())] if x]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else None

    def totals(self) -> DataFrame:
        rows = self._rows(*self._committed()[1:])
        if rows is None:
            return self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Replace the committed batches by one snapshot of their totals; False if another writer made the same number first."""
        number, snapshot, since = self._committed()
        rows = self._rows(snapshot, since)
        if rows is None:
            return False
        folder = self._write(rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
        digests = f"attempts/{uuid.uuid4().hex}"
        added = self.spark.createDataFrame([(name, x["digest"]) for name, x in since.items()], DIGESTS)
        self._digests(snapshot).unionByName(added).write.parquet(f"{self.path}/{digests}")
        if not self._claim(f"snapshots/{number + 1:012d}.json", {"folder": folder, "digests": digests}):
            for made in (folder, digests):
                self._fs().delete(self._at(made), True)
            return False
        for name in since:  # readers that still hold the older state read its folders, which stay
            self._fs().delete(self._at(f"batches/{name}.json"), False)
        return True


def counted(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """source, lang, the exact count n_tokens and the estimate by bytes est_tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = S.rank_encoder(path)
        for block in S.blocks(batches, "text"):
            n = encode(block.column("text"))[1]
            yield pa.RecordBatch.from_arrays([block.column("source"), block.column("lang"), block.column("est_tokens"), pa.array(n.astype(np.int64))], ["source", "lang", "est_tokens", "n_tokens"])

    own = docs.select("source", "lang", F.col(text_col).alias("text"), F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / 4).cast("long").alias("est_tokens"))
    return own.mapInArrow(run, "source string, lang string, est_tokens long, n_tokens long")


def op9(spark, sf_dir: str) -> DataFrame:
    """Documents are inserted with an estimate, revised to exact counts, and those without tokens deleted; each batch is sent twice, before and after the first ones are compacted."""
    version = "byte_bpe_50k"
    docs = S.cut(counted(S.documents(spark, sf_dir), S.tokenizer_path(f"{version}.tiktoken")), "counts")
    rollup = Rollup(spark, S.scratch(spark, "rollup"))
    for turn in range(2):
        if turn:
            rollup.compact()
        rollup.commit("1-insert", insert(docs, version, "est_tokens"))
        rollup.commit("2-revise", revise(docs, version, "est_tokens", "n_tokens"))
        rollup.commit("3-delete", delete(docs.where("n_tokens = 0"), version, "n_tokens"))
    return rollup.totals().withColumnRenamed("tokenizer", "tokenizer_version")
