"""New pages as a stream: each micro-batch is converted, and the table of documents is brought up to date by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import html
from ..sources.versioned import VersionedTable


def ingest(spark: SparkSession, pages_dir: str, table_dir: str, checkpoint: str, main_selectors: list[str] = html.MAIN_SELECTORS):
    """Start the stream; pages(page_id, url, html) arrive as Parquet files, VersionedTable(spark, table_dir, "page_id") has the documents.

    A micro-batch rewrites the buckets of its own pages, and is named after its number: one that is run again changes nothing.
    """
    table = VersionedTable(spark, table_dir, "page_id")

    def write(batch: DataFrame, number: int) -> None:
        blocks, _ = html.html_blocks(batch.dropDuplicates(["page_id"]), main_selectors)
        table.upsert(html.markdown(blocks), batch=f"{checkpoint}#{number}")

    pages = spark.readStream.schema("page_id long, url string, html string").parquet(pages_dir)
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
