"""The incremental job as a stream over the landing folder of change files.

Each micro-batch is folded into state rows (changefeed) and merged into the published state; the checkpoint takes the place of a
watermark, and since merging keeps sequences, a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexstrata.operators import changefeed


def apply_feed(spark: SparkSession, landing: str, schema: StructType, root: str, checkpoint: str, parts: Callable[[], dict], file_format: str = "parquet") -> StreamingQuery:
    """Apply all change files that have come since the last run, then stop; a batch rewrites the buckets that it touches and is published whole.

    parts: keys, seq, op and fields as changefeed.apply_changes takes them.
    """

    def batch(df: DataFrame, _: int) -> None:
        changefeed.apply_batch(df, root, **parts())

    stream = spark.readStream.schema(schema).format(file_format).load(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
