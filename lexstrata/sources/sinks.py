"""Sinks: JSON lines, the watermark, and published snapshots (operators.changefeed.publish)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.operators.changefeed import publish, read_published

__all__ = ["append_json", "chunk_records", "publish", "read_published", "read_watermark", "write_watermark"]


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunks as (id, text, metadata) records for a JSON-lines hand-over."""
    name = F.concat_ws("-", F.col("law_id"), (F.floor(F.col("article_no") / 100)).cast("string"), (F.col("article_no") % 100).cast("string"))
    return chunks.select(name.alias("id"), F.col("content").alias("text"), F.struct("law_id", "article_no", "paragraph_no", "title", F.col("valid_from").cast("string").alias("enforcement_date")).alias("metadata"))


def read_watermark(spark: SparkSession, root: str) -> dt.date | None:
    state = read_published(spark, root)
    return state.first()[0] if state is not None else None


def write_watermark(spark: SparkSession, root: str, day: dt.date, dry_run: bool = False) -> None:
    """The day up to which changes were applied; a dry run writes nothing."""
    if not dry_run:
        publish(spark.createDataFrame([(day,)], "last_synced_on date"), root)
