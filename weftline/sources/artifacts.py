"""Artifacts of preparation and evaluation: scans that check their rows, sinks, collections and their life cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators.bm25 import Index, analyzer
from .files import Folder
from .tables import new_only, settled, upsert
from .versioned import VersionedTable

#: A mapped test set: what a query is, and the chunks that are relevant for it.
TEST_SET = "query_id string, query string, query_type string, answer_type string, expected_answer_points array<string>, chunks array<struct<chunk_id:string,overlap_score:double,overlap_chars:bigint>>"

# ---------------------------------------------------------------- scans


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and line of the lines that hold no JSON object; blank lines are none of them."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    return rows.where(F.json_object_keys(F.col("line")).isNull())


def test_set(rows: DataFrame, needed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries, qrels(query_id, id, position) with each chunk once where it stands first, and rows in error.

    With needed a row must have a relevant chunk; without (for reviews) it need not. Ids and queries must not be blank.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ids = F.array_distinct(F.filter(F.coalesce(F.transform("chunks", lambda c: c["chunk_id"]), F.array().cast("array<string>")), lambda c: F.trim(c) != ""))
    error = F.when(blank("query_id"), "no query_id").when(blank("query"), "no query").when(F.lit(needed) & (F.size(ids) == 0), "no relevant chunk")
    own = rows.withColumns({"ids": ids, "error": error})
    sound = own.where("error IS NULL")
    qrels = sound.select("query_id", F.posexplode("ids").alias("position", "id")).select("query_id", "id", (F.col("position") + 1).cast("int").alias("position"))
    return sound.select("query_id", "query"), qrels, own.where("error IS NOT NULL").select("query_id", "error")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name of every line of a list that is not blank, each once."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def append_names(known: DataFrame, names: DataFrame, path: str) -> None:
    """Append the names that are not known yet as lines."""
    settled(new_only(names.select("name").distinct(), known, "name")).coalesce(1).write.mode("append").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("document_path"), F.col("value").alias("text"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and the SHA-256 of whole files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def token_lengths(rows: DataFrame, text_col: str = "text", count_col: str = "token_count") -> DataFrame:
    """token_length: the recorded count, else the number of words; rows with neither are left out."""
    recorded = F.col(count_col).cast("long") if count_col in rows.columns else F.lit(None).cast("long")
    return rows.withColumn("token_length", F.coalesce(recorded, word_count(text_col).cast("long"))).where("token_length IS NOT NULL")


def run_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The metric files that paths name: .lst files stand for their lines, less blank ones and those that begin with #. Lists are short."""
    out: list[str] = []
    for path in paths:
        lines = [r["line"] for r in spark.read.text(path).select(F.trim("value").alias("line")).collect()] if path.endswith(".lst") else [path]
        base = path.rpartition("/")[0]
        out += [x if "/" in x or not path.endswith(".lst") else f"{base}/{x}" for x in lines if x and not x.startswith("#")]
    return list(dict.fromkeys(out))


def as_list(x: Column) -> Column:
    """An array of the JSON text's strings, of one string for a text that is no JSON array, empty for null or blank."""
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(x, "array<string>"), F.array(x)))


# ---------------------------------------------------------------- counters


def counted_by(rows: DataFrame, statuses: list[str], col: str = "status") -> DataFrame:
    """One row: total, and the number of rows of each status, 0 where there is none."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(col) == s).alias(s) for s in statuses))


# ---------------------------------------------------------------- sinks


def store_new(rows: DataFrame, path: str, key: str, overwrite: bool = False) -> DataFrame:
    """Append rows whose key the table at path does not hold yet, or replace those it holds; the rows that were written."""
    spark = rows.sparkSession
    if not exists(spark, path) and exists(spark, f"{path}.next/_SUCCESS"):
        Folder(spark, path.rstrip("/").rsplit("/", 1)[0]).move(f"{path.rstrip('/')}.next".rsplit("/", 1)[1], path.rstrip("/").rsplit("/", 1)[1])
    old = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else None
    fresh = settled(rows if old is None or overwrite else new_only(rows, old, key))
    if old is None or not overwrite:
        fresh.write.mode("append").parquet(path)
    else:
        base, name = path.rstrip("/").rsplit("/", 1)
        folder = Folder(spark, base)
        upsert(old, fresh, key).write.mode("overwrite").parquet(f"{path}.next")
        folder.delete(name)  # a driver lost from here on leaves the whole new table beside, where the next call finds it
        folder.move(f"{name}.next", name)
    return fresh


def write_jsonl(df: DataFrame, path: str, ascii_only: bool = False, mode: str = "overwrite") -> None:
    """One object a line, null values as null; with ascii_only other characters are escaped."""
    df.write.mode(mode).option("ignoreNullFields", False).option("writeNonAsciiCharacterAsCodePoint", ascii_only).json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Replace the table of documents and its manifest (all columns but the text)."""
    own = settled(docs)
    own.write.mode("overwrite").parquet(f"{path}/documents")
    write_jsonl(own.drop("markdown", "text"), f"{path}/manifest")


def write_details(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------- collections and indexes


def exists(spark: SparkSession, path: str) -> bool:
    return Folder(spark, path).exists()


@dataclass
class Collections:
    """Vector collections under root: each a folder with versions of a table and a file of metadata."""

    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"{name!r} is no name of a collection")
        return f"{self.root}/{name}"

    def names(self) -> list[str]:
        own = Folder(self.spark, self.root)
        return [n for n in own.names() if own.exists(f"{n}/_metadata.json")]

    def get_or_create(self, name: str, metadata: dict) -> dict:
        """The collection's metadata; given ones if it is new."""
        own = Folder(self.spark, self._path(name))
        own.claim("_metadata.json", metadata)
        return own.read("_metadata.json")

    def _table(self, name: str, key: str = "chunk_id") -> VersionedTable:
        return VersionedTable(self.spark, self._path(name), key)

    def upsert(self, name: str, rows: DataFrame, key: str = "chunk_id", order: str | None = None, batch: str | None = None) -> DataFrame:
        """Replace rows of known keys and add the others, in their buckets alone. The collection afterwards.

        Of several rows of one key the greatest of order wins, or one by content; a named batch counts once.
        """
        self.get_or_create(name, {})
        self._table(name, key).upsert(rows, order, batch)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """The newest version, whole, whatever writers do meanwhile."""
        if name not in self.names():
            raise ValueError(f"no collection {name!r}; there are {', '.join(self.names()) or 'none'}")
        return self._table(name).read()

    def delete(self, name: str) -> bool:
        """False if there is none."""
        return Folder(self.spark, self._path(name)).delete()


def save_index(index: Index, path: str, stem: bool = False, stopwords: list[str] | None = None, source: str = "") -> None:
    """The index with a file beside it that says how its terms were made."""
    index.save(path)
    Folder(index.corpus.sparkSession, path).replace("_metadata.json", {"stem": stem, "stopwords": stopwords or [], "source": source})


def load_index(spark: SparkSession, path: str):
    """The index, the analyzer that its queries need, and its metadata."""
    from ..functions.stem import stemmed

    meta = Folder(spark, path).read("_metadata.json")
    if meta is None:
        raise ValueError(f"no index at {path}")
    return Index.load(spark, path), analyzer(meta["stopwords"], stemmed if meta["stem"] else None), meta
