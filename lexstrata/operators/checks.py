"""Invariants of ledger, index, graph and catalogue as one report: (check_name, n_bad)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.temporal import in_force
from lexstrata.operators import catalog, ledger

REPORT = ["check_name", "n_bad"]


def _count(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad")


def both_ways(name: str, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two stores has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return _count(name, a.join(b, keys, "left_anti").unionByName(b.join(a, keys, "left_anti")))


def ledger_checks(rows: DataFrame, day: Column, registered: DataFrame | None = None) -> DataFrame:
    """Overlaps, stale flags, empty or reversed periods, hashes that aren't 64 hex digits, and (if given) versions that aren't registered (law_id, mst)."""
    parts = [
        _count("overlapping_rows", ledger.overlap_flags(rows)),
        _count("is_current_stale", rows.where(F.col("is_current") != F.coalesce(in_force(day), F.lit(False)))),
        _count("period_not_forward", rows.where(F.col("valid_to") <= F.col("valid_from"))),
        _count("hash_length", rows.where(~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)))),
        _count("hash_differs", rows.where(F.sha2("content", 256) != F.col("content_hash"))),
    ]
    if registered is not None:
        known = registered.select("law_id", F.col("mst").alias("version_mst")).distinct()
        parts.append(_count("version_not_registered", rows.join(known, ["law_id", "version_mst"], "left_anti")))
    return reduce(DataFrame.unionByName, parts)


def boundary_checks(periods: DataFrame) -> DataFrame:
    """Days on which a period begins but not exactly one is in force."""
    starts = periods.select(*ledger.KEY, F.col("valid_from").alias("day")).distinct()
    return _count("start_without_exactly_one", ledger.boundary_hits(periods).join(starts, [*ledger.KEY, "day"], "left_semi").where("n_hits <> 1"))


def index_checks(rows: DataFrame, indexed: DataFrame, point: str) -> DataFrame:
    """Points of rows that shouldn't be in the index, rows that lack one, and points given twice."""
    twice = rows.where(F.col(point).isNotNull()).groupBy(point).agg(F.count_distinct("id").alias("n")).where("n > 1")
    should = indexed.select("id").distinct()
    has = rows.where(F.col(point).isNotNull()).select("id").distinct()
    return _count("point_missing", should.join(has, "id", "left_anti")).unionByName(_count("point_spare", has.join(should, "id", "left_anti"))).unionByName(_count("point_twice", twice))


def graph_checks(edges: DataFrame, nodes: DataFrame, families: DataFrame) -> DataFrame:
    """Self loops, citations across laws, delegations that don't lead down."""
    rank = nodes.select("article_pk", "law_id").join(families.select("law_id", "rank"), "law_id")
    met = edges.join(rank.toDF("l1", "src", "r1"), "src").join(rank.toDF("l2", "dst", "r2"), "dst")
    return (
        _count("self_loop", edges.where("src = dst"))
        .unionByName(_count("cites_other_law", met.where("rel = 'CITES' and l1 <> l2")))
        .unionByName(_count("delegates_not_down", met.where("rel = 'DELEGATES' and r1 >= r2")))
    )


def catalog_checks(nodes: DataFrame) -> DataFrame:
    """Codes of a bad length or given twice, leaves that aren't ten digits, leaves whose stored prefixes differ from their code's."""
    bad = catalog.bad_codes(nodes)
    leaf = F.length("code") == catalog.LEAF
    prefix = F.lit(False)
    for name, n in catalog.PREFIXES.items():
        prefix = prefix | (F.col(name) != F.substring("code", 1, n))
    return (
        _count("code_length", bad.where("problem = 'level'"))
        .unionByName(_count("code_twice", bad.where("problem = 'duplicate'")))
        .unionByName(_count("leaf_flag", nodes.where(F.col("is_leaf") != leaf)))
        .unionByName(_count("prefix_differs", nodes.where(leaf & prefix)))
    )


def requirement_checks(edges: DataFrame, approved: DataFrame) -> DataFrame:
    """Edges from codes of an odd level, laws without an agency, edges of a bad shape."""
    shape = F.col("trade_type").isin("수출", "수입") & ((F.coalesce("valid_from", F.lit("")) == "") | F.col("valid_from").rlike("^[0-9]{8}$"))
    laws = edges.select("law_code").distinct()
    return (
        _count("edge_level", edges.where(~F.length("hs").isin(2, 4, 6, 10)))
        .unionByName(_count("law_without_agency", laws.join(approved.select("law_code").distinct(), "law_code", "left_anti")))
        .unionByName(_count("edge_shape", edges.where(~F.coalesce(shape, F.lit(False)))))
    )


def law_report(rows: DataFrame, day: Column) -> DataFrame:
    """Per law: versions, current ones, open ones, and those not in force yet."""
    return rows.groupBy("law_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("is_current")).alias("n_current"), F.count_if(F.col("valid_to").isNull()).alias("n_open"), F.count_if(F.col("valid_from") > day).alias("n_future"),
    )
