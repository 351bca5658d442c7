"""The tables of a data directory as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexstrata.functions.text import digits_of
from lexstrata.operators import history, refgraph, requirements
from lexstrata.session import table


def live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_articles").where(F.col("deleted_at").isNull() & F.col("id").isNotNull())


def versions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Live rows of the version ledger without their texts, each id once (its earliest delivery): (id, loaded_at, columns; by default all); (id, loaded_at) finds the text in texts()."""
    rows = live(spark, d).drop("content")
    row = F.struct(*(columns or [c for c in rows.columns if c not in ("id", "loaded_at")]))
    return rows.groupBy("id").agg(F.min("loaded_at").alias("loaded_at"), F.coalesce(F.min_by(row, "loaded_at"), F.any_value(row)).alias("r")).select("id", "loaded_at", "r.*")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, loaded_at, is_current, content) of every delivery of a live row."""
    return live(spark, d).select("id", "loaded_at", "is_current", "content")


def slim_ledger(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Some columns of the live rows, each distinct row once; loaded_at and content stay in the scan."""
    return table(spark, d, "law_articles").where(F.col("deleted_at").isNull() & F.col("id").isNotNull()).select("id", *columns).distinct()


def history_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row a key and start with its own end cut at the next start: (key, valid_from, valid_to, id, content_hash, version_mst, title)."""
    keys = ["law_id", "article_no", "paragraph_no"]
    rows = table(spark, d, "law_articles").where(F.col("deleted_at").isNull())
    best = history.counting(history.first_deliveries(rows, keys, "valid_from", "id", "loaded_at", ["valid_to", "content_hash", "version_mst", "title"]), keys, "valid_from")
    nxt = F.lead("valid_from").over(W.partitionBy(*keys).orderBy("valid_from"))
    return best.withColumn("valid_to", F.least("valid_to", nxt)).withColumnRenamed("row_id", "id").drop("loaded")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot's nodes, one row a code (the last delivered), codes as digits."""
    nodes = table(spark, d, "hs_node_snapshots")
    return snapshot_nodes(nodes, nodes.agg(F.max("snapshot_date")))


def snapshot_nodes(nodes: DataFrame, day: DataFrame) -> DataFrame:
    """Nodes of one snapshot; day: one row, one column."""
    columns = ["code", "name_ko", "name_en", "is_leaf", "hs6", "heading4", "chapter2"]
    rows = nodes.where(F.col("snapshot_date") == day.scalar()).withColumn("code", digits_of("code")).where(F.col("code").isNotNull())
    last = F.max_by(F.struct(*columns[1:]), F.struct("loaded_at", "row_id"))
    return rows.groupBy("code").agg(last.alias("r")).select("code", "r.*")


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Items of the sweep log whose product the catalogue has."""
    return requirements.known_products(requirements.sweep_items(table(spark, d, "ccct_progress")), catalogue(spark, d))


def requirement_paths(spark: SparkSession, d: str) -> DataFrame:
    items = sweep(spark, d)
    laws, agencies = requirements.first_names(items, "law_code", "law_name"), requirements.first_names(items, "agency_code", "agency_name")
    return requirements.traverse(requirements.requires_edges(items), laws, requirements.approvals(items), agencies)


def citation_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, references, edges)."""
    laws, articles = table(spark, d, "laws"), table(spark, d, "law_articles").where(F.col("deleted_at").isNull())
    families = refgraph.law_families(laws)
    nodes = refgraph.article_nodes(articles, laws)
    refs = refgraph.node_references(articles, nodes, families)
    return nodes, refs, refgraph.graph_edges(nodes, refs, families)
