import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from lexstrata.operators import index

D = dt.date
LEDGER = "id long, law_id string, article_no int, paragraph_no int, version_mst string, valid_from date, valid_to date, is_current boolean, parent_article_pk long, qdrant_point_id string"


def test_maintenance(spark):
    data = [
        (1, "L", 100, None, "m1", D(2020, 1, 1), D(2024, 1, 1), True, None, "p1"),  # ended: its point goes
        (2, "L", 100, None, "m2", D(2024, 1, 1), None, False, None, None),  # begins: gets one
        (3, "L", 200, None, "m1", D(2020, 1, 1), None, True, None, "p3"), (4, "L", 300, None, "m1", D(2020, 1, 1), None, True, None, None),
        (5, "L", 300, 1, "m1", D(2020, 1, 1), None, True, 4, None),  # its parent isn't indexed
        (6, "L", 400, None, "m3", D(2030, 1, 1), None, False, None, None),
    ]
    ledger = spark.createDataFrame(data, LEDGER)
    points = ledger.where("qdrant_point_id is not null").select(F.col("qdrant_point_id").alias("point"), F.col("id").alias("article_pk"))
    after, idx = index.maintain(ledger, points, F.lit(D(2024, 6, 1)))
    assert rows(idx, "article_pk") == [(2,), (3,), (5,)]
    got = {r.id: r.qdrant_point_id for r in after.collect()}
    assert got[3] == "p3" and got[1] is got[4] is got[6] is None and len(got[2]) == len(got[5]) == 36
    assert rows(after.where("is_current"), "id") == [(2,), (3,), (4,), (5,)]
    again, idx2 = index.maintain(after, idx, F.lit(D(2024, 6, 1)))
    assert rows(again) == rows(after) and rows(idx2) == rows(idx)
    none = index.maintain(ledger.limit(0), points.limit(0), F.lit(D(2024, 6, 1)))
    assert [x.count() for x in none] == [0, 0]


def test_points(spark):
    idx = spark.createDataFrame([("a", 1), ("b", 2)], "point string, article_pk long")
    assert rows(index.upsert_points(idx, spark.createDataFrame([("b", 9), ("c", 3)], idx.schema))) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(index.delete_points(idx, spark.createDataFrame([("b",), ("x",)], "point string"))) == [("a", 1)]


def test_ensure(spark, tmp_path):
    path = str(tmp_path / "i")
    schema = spark.range(1).schema
    assert index.ensure(spark, path, schema)
    spark.range(3).write.mode("append").parquet(path)
    assert not index.ensure(spark, path, schema)
    assert spark.read.parquet(path).count() == 3
