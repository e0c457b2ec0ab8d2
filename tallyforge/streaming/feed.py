"""An upload folder as a stream: an extension of the batch operators, which has no counterpart in the receipt service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract


def text_feed(spark: SparkSession, path: str) -> DataFrame:
    """Receipts as JSON lines (doc_id, text) that arrive in a folder."""
    return spark.readStream.schema("doc_id long, text string").json(path)


def run_feed(feed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Extracts every arrival once and appends it as Parquet; stops when all present files are done."""
    results = extract(feed).select("doc_id", "bank", "reference_id", "date", "amount", "needs_review", F.current_timestamp().alias("seen"))
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
