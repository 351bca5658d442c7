from pyspark.sql import functions as F

from lexstrata import session


def test_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 9, 1, 1), spark.range(0, 9, 1, cores)
    assert session.spread(few).rdd.getNumPartitions() == cores and session.spread(few).count() == 9
    assert session.spread(many) is many
    grouped = few.groupBy("id").agg(F.count(F.lit(1)))
    assert session.spread(grouped) is grouped


def test_written(spark):
    df = spark.range(3).withColumn("x", F.lit(None).cast("timestamp_ntz"))
    got = session.written(df)
    assert got.schema.names == df.schema.names and got.count() == 3
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")
