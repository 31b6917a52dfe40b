"""Artifact tables: schemas, checked reads, and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder

#: Columns of artifacts, and those that must have a value (for text: a non-empty one).
RAW_MANIFEST = "document_id string, title string, source_url string, source_type string, product_area string, fetch_timestamp string, raw_file_path string"
PROCESSED_MANIFEST = RAW_MANIFEST + ", topic string, processed_file_path string"
CHUNKS = "chunk_id string, document_id string, chunk_index int, strategy string, title string, heading_path array<string>, content string, char_span array<int>, text string, token_count int, source_url string, source_type string, product_area string, processed_file_path string, topic string"
REQUIRED = {
    "raw_manifest": ["document_id", "title", "source_url", "source_type", "product_area", "raw_file_path"],
    "processed_manifest": ["document_id", "title", "source_url", "source_type", "product_area", "topic", "processed_file_path"],
    "chunks": ["chunk_id", "text", "title", "source_url", "document_id", "chunk_index", "strategy", "token_count", "char_span"],
}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def violations(df: DataFrame, required: list[str], blank_is_missing: bool = True) -> DataFrame:
    """Rows that lack a required value, with the names of what they lack."""
    lacking = []
    for c in required:
        gone = F.col(c).isNull()
        if blank_is_missing and dict(df.dtypes)[c] == "string":
            gone = gone | (F.col(c) == "")
        lacking.append(F.when(gone, F.lit(c)))
    return df.withColumn("missing", F.array_compact(F.array(*lacking))).where(F.size("missing") > 0)


def checked(df: DataFrame, kind: str) -> DataFrame:
    """df, or an error that shows the first rows in violation; chunks must have blank-free ids and texts, and one row at least."""
    blank = [c for c in ("chunk_id", "text") if kind == "chunks"]
    own = df.withColumns({c: F.when(F.regexp_replace(F.col(c), r"(?U)\s", "") != "", F.col(c)) for c in blank}) if blank else df
    bad = violations(own, REQUIRED[kind], kind != "chunks").limit(5).collect()
    if bad:
        raise ValueError(f"{kind}: required values are missing: {[r['missing'] for r in bad]}")
    if kind == "chunks" and df.isEmpty():
        raise ValueError("chunks: there are none")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in a local session without it."""
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(root)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written once to spark.checkpoint.dir: what is read twice is the same both times, whatever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/weftline-{what}-{uuid.uuid4().hex}"


def index_payload(chunks: DataFrame) -> DataFrame:
    """Flat columns of a chunk for an index, with defaults."""
    text = lambda c, other="": F.coalesce(F.col(c), F.lit(other)).alias(c)
    return chunks.select(
        "chunk_id", "document_id", F.col("chunk_index").cast("int"), "strategy", "title", F.to_json(F.coalesce("heading_path", F.array().cast("array<string>"))).alias("heading_path"), "source_url",
        text("source_type"), text("product_area"), text("topic", "N.A."), text("processed_file_path"), F.col("token_count").cast("int"),
        F.get("char_span", F.lit(0)).alias("start_idx"), F.get("char_span", F.lit(1)).alias("end_idx"), "text",
    )


def upsert(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return new if old is None else new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def new_only(rows: DataFrame, existing: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Rows whose key is not known yet; all of them with overwrite."""
    return rows if overwrite else rows.join(existing.select(key).distinct(), key, "left_anti")


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """label, k, metric and value of metric files: {"metadata": ..., "metrics_by_k": {k: {metric: value}}}."""
    rows = spark.read.schema("metadata map<string,string>, metrics_by_k map<string,map<string,double>>").option("multiLine", True).json(paths).withColumn("label", F.element_at(F.split(F.input_file_name(), "/"), -1))
    by_k = rows.select("label", F.explode("metrics_by_k").alias("k", "metrics"))
    return by_k.select("label", F.col("k").cast("int").alias("k"), F.explode("metrics").alias("metric", "value"))


def write_summary(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Metrics by cutoff (a row each, as few as there are cutoffs) as one JSON file, in any file system that Spark knows."""
    rows = {str(r["k"]): {c: r[c] for c in df.columns if c != "k"} for r in df.orderBy("k").collect()}
    base, _, name = path.rpartition("/")
    Folder(df.sparkSession, base or ".").replace(name, {"metadata": metadata or {}, "metrics_by_k": rows})
