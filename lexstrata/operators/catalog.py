"""The product catalogue: a hierarchy by code prefix, its sheets, and year-on-year differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexstrata.functions.text import PREFIXES

# The lengths a code may have.
LEVELS = (2, 4, 5, 6, 7, 8, 9, 10)
LEAF = 10


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    """All sheets of (code, name_ko, name_en), all strings, with level; a sheet of another width raises ValueError."""
    names = ["code", "name_ko", "name_en"]
    if bad := [len(s.columns) for s in sheets if len(s.columns) != len(names)]:
        raise ValueError(f"sheets must have three columns, not {bad}")
    rows = reduce(DataFrame.unionByName, [s.toDF(*names).select(*[F.col(n).cast("string").alias(n) for n in names]) for s in sheets])
    return rows.withColumn("level", F.length("code")).withColumn("is_leaf", F.length("code") == LEAF)


def bad_codes(nodes: DataFrame) -> DataFrame:
    """(code, problem): codes of a wrong length, and codes given more than once."""
    level = nodes.where(~F.length("code").isin(*LEVELS) | F.col("code").isNull()).select("code", F.lit("level").alias("problem"))
    twice = nodes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code", F.lit("duplicate").alias("problem"))
    return level.unionByName(twice).distinct()


def prefix_columns(nodes: DataFrame) -> DataFrame:
    """Leaves with the codes of their ancestors; other nodes with nulls."""
    leaf = F.length("code") == LEAF
    return nodes.withColumns({name: F.when(leaf, F.substring("code", 1, n)) for name, n in PREFIXES.items()})


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """Each leaf with the names of its ancestors (null where the catalogue has no such node): equi-joins on derived prefixes."""
    out = prefix_columns(nodes).where(F.length("code") == LEAF)
    for name in PREFIXES:
        names = nodes.select(F.col("code").alias(name), F.col("name_ko").alias(f"{name}_name"))
        out = out.join(names, name, "left")
    return out


def leaf_attributes(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Nodes with the leaves' attributes by code; has_attributes tells leaves that found none."""
    marked = attributes.withColumn("has_attributes", F.lit(True))
    out = nodes.join(marked, "code", "left")
    return out.withColumn("has_attributes", F.when(F.length("code") == LEAF, F.coalesce("has_attributes", F.lit(False))))


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming nodes replace stored ones of their code altogether; codes that don't come in remain."""
    return stored.join(incoming.select("code"), "code", "left_anti").select(*incoming.columns).unionByName(incoming)


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(code, change, old_name, new_name): added, removed, renamed (null equals null). One row a code on both sides."""
    a = old.select("code", F.col("name_ko").alias("old_name"), F.lit(1).alias("o"))
    b = new.select("code", F.col("name_ko").alias("new_name"), F.lit(1).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old_name").eqNullSafe(F.col("new_name")), "renamed")
    return a.join(b, "code", "full_outer").select("code", change.alias("change"), "old_name", "new_name").where("change is not null")


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.length("code").alias("level")).agg(F.count(F.lit(1)).alias("n_nodes"))


def snapshot_diffs(rows: DataFrame, days: DataFrame) -> DataFrame:
    """catalog_diff of every two consecutive snapshots: (day of the later one, code, change, old_name, new_name).

    rows: (code, day, name_ko), one a code and snapshot; days: (day) of all snapshots. The first one has nothing before it.
    """
    order = W.orderBy("day")
    days = days.select("day").where(F.col("day").isNotNull()).distinct().select("day", F.lag("day").over(order).alias("before"), F.lead("day").over(order).alias("next"))
    told = rows.join(F.broadcast(days), "day")  # a DATE has a bounded number of values
    old = told.where(F.col("next").isNotNull()).select("code", F.col("next").alias("day"), F.col("name_ko").alias("old_name"), F.lit(1).alias("o"))
    new = told.where(F.col("before").isNotNull()).select("code", "day", F.col("name_ko").alias("new_name"), F.lit(1).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old_name").eqNullSafe(F.col("new_name")), "renamed")
    return old.join(new, ["code", "day"], "full_outer").select("day", "code", change.alias("change"), "old_name", "new_name").where("change is not null")
