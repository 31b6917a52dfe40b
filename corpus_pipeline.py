"""Corpus pipeline: five operators one after another over whole documents.

Language, toxicity and near-duplicate stages take documents out, the secret stage rewrites texts, the last packs what is
left into sequences. Each stage's result is written as Parquet and read again as the next one's documents.

Defined results: documents without a letter or whose language stays ambiguous go in the first stage; rows of equal id
and text count as copies; a document without shingles has no copies and stays; an empty table packs into no sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import jaccard_join, lang_ecoc, lp_packing, secret_markov, shared, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the codes tell."""
    found = lang_ecoc.identify(docs, lang_ecoc.train(docs), carry=True)
    return found.where("lang_pred <> 'und' AND NOT lang_ambiguous").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not hold for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.train(docs, labels), carry=True).where("toxic_score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of every group of linked ones; rows without an id stay."""
    groups = shared.cut(jaccard_join.join(docs), "groups")
    kept = F.max(F.col("doc_id") == F.col("component_id"))
    gone = shared.cut(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(kept.alias("kept")).where("NOT kept").select("doc_id"), "gone")
    rows, ids = groups.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    once = docs.dropDuplicates(["doc_id", "text"]) if ids < rows else docs
    # ids of few rows are broadcast, so that texts stay where they are; those of more are joined by a shuffle
    few = gone.count() <= jaccard_join.SHIPPED
    return once.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars brought up to date."""
    out = secret_markov.masked(docs, secret_markov.train(secret_markov.labelled_samples(spark)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences."""
    return lp_packing.pack(docs, shared.tokenizer_path("byte_bpe_50k.json"), end_id=2)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]
#: Models and similarity joins of several stages: SQL can't express them; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return docs
