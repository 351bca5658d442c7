"""History of changing attributes: insert-only satellites and end dates in lead-based views.

Attributes are split by how often they change; each group is a satellite of the hub key. A load appends to a satellite the versions
whose hash_diff (over the group's attributes and the version's own end) differs from what counts so far for their
key and start, and nothing else; nothing is ever updated. Which row of a start counts, the end of a period and the joining of
periods that touch with equal attributes exist only in the view: the last loaded row of each start, the next row's start by lead.

Of the versions of a key with one start the last loaded counts. That choice is an aggregate combined map-side, and
afterwards a key has at most one row a day, so the ordered window over a key is of bounded size however often one
key was delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

def first_deliveries(rows: DataFrame, keys: list[str], start: str, row_id: str, loaded: str, attributes: list[str]) -> DataFrame:
    """(row_id, keys, start, loaded, attributes): each id once a key and start, as it was first delivered.

    Rows without a start are left out; null key parts are keys.
    """
    delivered = rows.where(F.col(start).isNotNull()).groupBy(row_id, *keys, start).agg(F.min(loaded).alias("__loaded"), F.min_by(F.struct(*attributes), F.struct(loaded, *attributes)).alias("__row"))
    return delivered.select(F.col(row_id).alias("row_id"), *keys, start, F.col("__loaded").alias("loaded"), "__row.*")


def counting(versions: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Of each key and start the row with the latest load time, then the largest id."""
    others = [c for c in versions.columns if c not in (*keys, start)]
    best = F.max_by(F.struct(*others), F.struct("loaded", "row_id"))
    return versions.groupBy(*keys, start).agg(best.alias("__row")).select(*keys, start, "__row.*")


def counting_versions(rows: DataFrame, keys: list[str], start: str, row_id: str, loaded: str, attributes: list[str]) -> DataFrame:
    """One row a key and start: the row with the latest load time (its id's earliest delivery), then the largest id."""
    return counting(first_deliveries(rows, keys, start, row_id, loaded, attributes), keys, start).select(*keys, start, *attributes)


def hash_diff(attributes: list[str]) -> Column:
    """sha256 over the attributes with lengths, so that neither nulls nor moved separators make two rows equal."""
    parts = [F.coalesce(F.concat(F.length(F.col(a).cast("string")).cast("string"), F.lit(":"), F.col(a).cast("string")), F.lit("-")) for a in attributes]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on], how)


def new_deliveries(seen: DataFrame | None, deliveries: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Deliveries (first_deliveries of a load) of ids not seen in an earlier load; seen: (row_id, keys, start)."""
    return deliveries if seen is None else _met(deliveries, seen, ["row_id", *keys, start], "left_anti")


def satellite_rows(stored: DataFrame | None, deliveries: DataFrame, keys: list[str], start: str, attributes: list[str], carried: list[str], counted: bool = False) -> DataFrame:
    """Rows to append to a satellite: (keys, start, loaded, row_id, hash_diff, carried, attributes).

    stored: the satellite so far, of earlier load times than all deliveries; None: empty. deliveries: the load's new ones
    (new_deliveries). Of a load the counting row of each key and start is looked at; it is appended if there's none stored or if the
    stored one that counts has another hash_diff (over carried and attributes). Nothing stored changes. counted: deliveries hold
    counting rows only, of counting().
    """
    columns = [*keys, start, "loaded", "row_id", "hash_diff", *carried, *attributes]
    rows = deliveries if counted else counting(deliveries, keys, start)
    rows = rows.withColumn("hash_diff", hash_diff([*carried, *attributes])).select(*columns)
    if stored is None:
        return rows
    return _met(rows, counting(stored, keys, start).select(*keys, start, "hash_diff"), [*keys, start, "hash_diff"], "left_anti")


def periods(sat: DataFrame, keys: list[str], start: str, end: str, watched: list[str], one_load: bool = False) -> DataFrame:
    """The view over a satellite: (keys, start, end, and the other columns of the row that began the period).

    A period runs from a counting row's start to the earlier of its own end (exclusive; null: open) and the next counting row's start; rows
    whose own period is empty never held, but end the one before. Periods that touch and are equal in `watched` are one. one_load: the
    satellite was filled at once, so it has but one row a key and start.
    """
    by_key = W.partitionBy(*keys).orderBy(start)
    rows = sat if one_load else counting(sat, keys, start)
    held = rows.withColumn(end, F.least(end, F.lead(start).over(by_key))).where(F.col(end).isNull() | (F.col(end) > F.col(start)))
    held = held.withColumn("__watched", F.struct(*watched))
    held = held.withColumn("__was", F.lag(F.struct(F.col(end).alias("e"), F.col("__watched").alias("w"))).over(by_key))
    held = held.withColumn("__last", F.max(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))).over(W.partitionBy(*keys).orderBy(start).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    fresh = held.where(F.col("__was").isNull() | ~(F.col("__was.e").eqNullSafe(F.col(start)) & F.col("__was.w").eqNullSafe(F.col("__watched"))))
    stop = F.when(F.lead(F.lit(1)).over(by_key).isNull(), F.col("__last.e")).otherwise(F.lead("__was.e").over(by_key))
    return fresh.withColumn(end, stop).drop("__watched", "__was", "__last")


def change_rates(versions: DataFrame, keys: list[str], start: str, attributes: list[str]) -> DataFrame:
    """(attribute, rate): the share of a key's successive versions in which the attribute differs."""
    by_key = W.partitionBy(*keys).orderBy(start)
    flags = [(~F.lag(F.struct(a)).over(by_key)[a].eqNullSafe(F.col(a)) & F.lag(F.lit(1)).over(by_key).isNotNull()).cast("int").alias(a) for a in attributes]
    counted = versions.select(F.lag(F.lit(1)).over(by_key).alias("__pair"), *flags)
    sums = counted.agg(F.count("__pair").alias("n"), *[F.sum(a).alias(a) for a in attributes])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("k")) for a in attributes]))
    return sums.select("n", pairs.alias("p")).select("p.attribute", (F.coalesce("p.k", F.lit(0)) / F.greatest("n", F.lit(1))).alias("rate"))


def split_by_rate(rates: DataFrame, threshold: float = 0.1) -> dict[str, list[str]]:
    """Attributes for the 'slow' and the 'fast' satellite; one row an attribute comes to the driver."""
    out: dict[str, list[str]] = {"slow": [], "fast": []}
    for row in sorted(rates.collect()):
        out["fast" if row["rate"] > threshold else "slow"].append(row["attribute"])
    return out


def holds_on(start: str, end: str, day: Column) -> Column:
    """Whether the period [start, end) holds the day; an open end is null."""
    return (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day))
