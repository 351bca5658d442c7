"""Maintenance of a search index kept as a table of points: create it, promote versions, delete and add points, write them back.

Every function returns the next state; changefeed.publish() makes it the one in force. Only what has to change is encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexstrata.functions.text import point_id
from lexstrata.operators.chunking import indexable
from lexstrata.operators.ledger import promote

POINT = "qdrant_point_id"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ensure(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Create an empty table where there's none; what is there is never dropped. Whether it was created."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return True


def upsert_points(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming points replace those of their id. Both: (point, ...), one row a point."""
    return index.join(incoming.select("point"), "point", "left_anti").select(*incoming.columns).unionByName(incoming)


def delete_points(index: DataFrame, points: DataFrame) -> DataFrame:
    """The index without the points (point, or point and article_pk where a point may have been given twice); unknown ones are nothing to delete."""
    return index.join(points.distinct(), points.columns, "left_anti")


def write_back(ledger: DataFrame, points: DataFrame) -> DataFrame:
    """The ledger with the points (point, article_pk) of its rows, null where a row has none."""
    given = points.select(F.col("article_pk").alias("id"), F.col("point").alias("__point"))
    return ledger.join(given, "id", "left").withColumn(POINT, F.col("__point")).drop("__point").select(*ledger.columns)


def maintain(ledger: DataFrame, index: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """(ledger, index) on a day: flags promoted, points of rows no longer current deleted, rows to be indexed that have no point given one.

    ledger: one row an id with KEY, version_mst, valid_from, valid_to, is_current, parent_article_pk and the point; index: (point, article_pk).
    Running it twice on a day changes nothing the second time.
    """
    now = promote(ledger, day)
    gone = now.where(~F.col("is_current") & F.col(POINT).isNotNull()).select(F.col(POINT).alias("point"), F.col("id").alias("article_pk"))
    fresh = indexable(now, POINT, pending_only=True)
    fresh = fresh.select(point_id(F.col("law_id"), F.col("article_no"), F.col("paragraph_no"), F.col("version_mst")).alias("point"), F.col("id").alias("article_pk"))
    after = upsert_points(delete_points(index, gone), fresh)
    return write_back(now, after), after
