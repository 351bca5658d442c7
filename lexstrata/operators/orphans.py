"""References to records that do not exist: missing, deleted or late parents.

References and parents are hash-partitioned and sorted on the key and merged in one pass (a sort-merge join,
forced by a hint so that no side is ever broadcast or collected). Parents come as validity intervals
[born, gone); a reference at time t with a known key is sound if some interval holds t, 'deleted' if none does
but one ended at or before t, 'late' if all begin after t, and 'missing' if the key has no interval at all.

Hot keys: a key named by more than 1/HOT_SHARE of all references is spread over as many salts as a shuffle has partitions. There can be
at most HOT_SHARE such keys, whatever the data, so their list may be broadcast; their parent rows, one a key,
are repeated once a salt. AQE's skew join splits whatever is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOT_SHARE = 200
KINDS = ("missing", "deleted", "late")


def parent_intervals(parents: DataFrame, key: Column, born: Column, gone: Column) -> DataFrame:
    """One row a key with its distinct validity intervals in order: (key, spans ARRAY<STRUCT<born, gone>>).

    born null: valid since ever; gone null: still valid. Rows with a null key are left out. Repeated deliveries
    give equal intervals and collapse before the shuffle's final merge (collect_set is combined map-side), so a
    key holds as many as it has different lives.
    """
    low, high = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    span = F.struct(F.coalesce(born.cast("timestamp_ntz"), low).alias("born"), F.coalesce(gone.cast("timestamp_ntz"), high).alias("gone"))
    rows = parents.select(key.alias("key"), span.alias("span")).where(F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def presence_intervals(snapshots: DataFrame, key: Column, day: str) -> DataFrame:
    """Parent intervals from full snapshots: a key seen in a snapshot is valid from its day to the next snapshot's."""
    days = snapshots.select(F.col(day).alias("__day")).where(F.col("__day").isNotNull()).distinct()
    days = days.select("__day", F.lead("__day").over(W.orderBy("__day")).alias("__next"))
    seen = snapshots.select(key.alias("__key"), F.col(day).alias("__day")).where(F.col("__key").isNotNull()).distinct()
    # A join by day would gather each snapshot in one task; a DATE has a bounded number of values, deliveries far fewer.
    return parent_intervals(seen.join(F.broadcast(days), "__day"), F.col("__key"), F.col("__day"), F.col("__next"))


def _salted(refs: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    salts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(HOT_SHARE * 100))).scalar()
    hot = counts.where(F.col("n") * HOT_SHARE > total).select("key", F.lit(True).alias("hot"))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("row_id", "at"), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    refs = refs.join(F.broadcast(hot), "key", "left").withColumn("salt", spread).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return refs, parents.join(F.broadcast(hot), "key", "left").select("key", "spans", F.explode(copies).alias("salt"))


def find_orphans(refs: DataFrame, parents: DataFrame, salted: bool = True) -> DataFrame:
    """Dangling rows of refs (ref_name, row_id, key, at) as (ref_name, row_id, kind, period), distinct.

    refs.key null: no reference, left out. at null: the time is unknown, so only 'missing' can be told; its period
    is null. parents: (key, spans) of parent_intervals or presence_intervals; an empty table makes every
    reference missing. Other columns are ignored, whatever their names. Ties at a boundary follow [born, gone).
    """
    refs = refs.select("ref_name", "row_id", F.col("key"), F.col("at").cast("timestamp_ntz").alias("at")).where(F.col("key").isNotNull())
    parents = parents.select("key", "spans")
    if salted:
        refs, parents = _salted(refs, parents)
        on = ["key", "salt"]
    else:
        on = ["key"]
    merged = refs.hint("merge").join(parents, on, "left")
    holds = F.exists("spans", lambda s: (s["born"] <= F.col("at")) & (F.col("at") < s["gone"]))
    ended = F.exists("spans", lambda s: s["gone"] <= F.col("at"))
    kind = (
        F.when(F.col("spans").isNull(), "missing").when(F.col("at").isNull() | holds, None).when(ended, "deleted").otherwise("late")
    )
    return (
        merged.select("ref_name", "row_id", kind.alias("kind"), F.date_format("at", "yyyy-MM").alias("period"))
        .where(F.col("kind").isNotNull())
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per reference, month and kind."""
    return orphans.groupBy("ref_name", "period", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
