"""Queries of what keeps the stores up to date: versions applied to the ledger, the index, the catalogue, the graph; and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions import temporal, text
from lexstrata.operators import catalog, checks, index, ledger, refgraph
from lexstrata.plans import views
from lexstrata.plans.reference import AS_OF, BEST, CITED, HOLDS, KEY, LIVE, NODES, SNAP, day, feed, incoming_versions, query
from lexstrata.plans.reference import _FEED as FEED
from lexstrata.plans.reference import _ONE as ONE
from lexstrata.plans.reference import _SPACE as SPACE
from lexstrata.session import cut_lineage, scratch_path, table

_SNAP = SNAP.replace("content_hash FROM", "content_hash, title, version_mst FROM")
_REPEALED = f"SELECT DISTINCT law_id FROM ({FEED}) WHERE revision_type = '폐지'"
_H = HOLDS.format(d=AS_OF)
#: The ledger after the newest snapshot has been applied to every law as its new version; laws with a repeal in the feed are closed.
_APPLIED = f"""{BEST}, {_SNAP}, led AS (SELECT *, {_H} AS is_current FROM hist),
e AS (SELECT law_id, max(valid_from) AS effective_on, law_id IN ({_REPEALED}) AS repeal FROM snap GROUP BY law_id),
o AS (SELECT led.*, effective_on FROM led JOIN e USING (law_id) WHERE valid_to IS NULL),
n AS (SELECT snap.* FROM snap JOIN e USING (law_id) WHERE NOT repeal),
m AS (SELECT o.law_id AS ol, coalesce(o.law_id, n.law_id) AS law_id, coalesce(o.article_no, n.article_no) AS article_no, coalesce(o.paragraph_no, n.paragraph_no) AS paragraph_no, o.id, o.valid_from AS of, n.valid_from AS nf, o.content_hash AS oh, n.content_hash AS nh,
    o.title AS ot, n.title AS nt, o.version_mst AS om, n.version_mst AS nm, effective_on, o.is_current
  FROM o FULL JOIN n ON o.law_id = n.law_id AND o.article_no = n.article_no AND o.paragraph_no IS NOT DISTINCT FROM n.paragraph_no),
applied AS (
  SELECT id, law_id, article_no, paragraph_no, valid_from, valid_to, content_hash, version_mst, title, is_current FROM led WHERE NOT (valid_to IS NULL AND law_id IN (SELECT law_id FROM e))
  UNION ALL SELECT id, law_id, article_no, paragraph_no, of, CASE WHEN nf > of AND nh <> oh THEN nf WHEN nf IS NULL AND of < effective_on THEN effective_on END,
    CASE WHEN nf = of AND nh <> oh THEN nh ELSE oh END, CASE WHEN nf = of AND nh <> oh THEN nm ELSE om END, CASE WHEN nf = of AND nh <> oh THEN nt ELSE ot END, is_current FROM m WHERE of IS NOT NULL
  UNION ALL SELECT NULL, law_id, article_no, paragraph_no, nf, NULL, nh, nm, nt, false FROM m WHERE nf IS NOT NULL AND (of IS NULL OR (nf > of AND nh <> oh)))"""


def _applied(spark: SparkSession, d: str) -> DataFrame:
    rows = views.history_rows(spark, d).withColumn("is_current", F.coalesce(temporal.in_force(day()), F.lit(False)))
    snaps = table(spark, d, "article_snapshots")
    new = snaps.where(F.col("snapshot_date") == snaps.agg(F.max("snapshot_date")).scalar())
    new = new.groupBy(*KEY).agg(F.max_by(F.struct(F.col("enforcement_date").alias("valid_from"), "content_hash", "title", "version_mst"), F.struct("loaded_at", "content_hash")).alias("r")).select(*KEY, "r.*")
    repealed = feed(spark, d).where("revision_type = '폐지'").select("law_id", F.lit(True).alias("repeal")).distinct()
    effective = new.groupBy("law_id").agg(F.max("valid_from").alias("effective_on")).join(repealed, "law_id", "left")
    return ledger.apply_versions(rows, new, effective)


_COLUMNS = "id, law_id, article_no, paragraph_no, valid_from, valid_to, content_hash, version_mst, title, is_current"


@query(f"WITH {_APPLIED} SELECT {_COLUMNS} FROM applied")
def apply_versions(spark: SparkSession, d: str) -> DataFrame:
    """A new version of every law applied: amended, corrected, stale, removed, added and repealed units."""
    return _applied(spark, d).select(*_COLUMNS.split(", "))


@query(f"WITH {_APPLIED} SELECT count(*) AS n_rows, count(*) FILTER (id IS NULL) AS n_new, count(*) AS n_ids, coalesce(max(id), 0) + count(*) FILTER (id IS NULL) AS last_id FROM applied")
def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    """New rows get the numbers behind the largest, each once."""
    rows = cut_lineage(_applied(spark, d))
    got = ledger.assign_ids(rows, [*KEY, "valid_from"])
    return got.agg(F.count(F.lit(1)).alias("n_rows"), rows.where("id is null").agg(F.count(F.lit(1))).scalar().alias("n_new"), F.count_distinct("id").alias("n_ids"), F.max("id").alias("last_id"))


@query(f"WITH {_APPLIED} SELECT is_current AS was, coalesce({HOLDS.format(d='2027-01-01')}, false) AS is_now, count(*) AS n_rows FROM applied GROUP BY ALL")
def preloaded_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions that come before their day wait, not current, until promoted on a later one."""
    rows = _applied(spark, d).withColumn("was", F.col("is_current"))
    return ledger.promote(rows, day("2027-01-01")).groupBy("was", F.col("is_current").alias("is_now")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT 0::BIGINT AS demoted, 0::BIGINT AS promoted")
def promote_twice(spark: SparkSession, d: str) -> DataFrame:
    """After a promotion a second one on the same day changes nothing."""
    return ledger.promote_counts(ledger.promote(views.slim_ledger(spark, d, "valid_from", "valid_to", "is_current"), day()), day())


@query(
    f"""WITH {BEST}, {SNAP} SELECT CASE WHEN o.valid_from IS NULL THEN 'added' WHEN n.content_hash = o.content_hash THEN 'same' WHEN n.valid_from < o.valid_from THEN 'stale' WHEN n.valid_from = o.valid_from THEN 'corrected' ELSE 'amended' END AS status, count(*) AS n_rows
    FROM snap n LEFT JOIN (SELECT * FROM hist WHERE valid_to IS NULL) o ON o.law_id = n.law_id AND o.article_no = n.article_no AND o.paragraph_no IS NOT DISTINCT FROM n.paragraph_no GROUP BY ALL"""
)
def load_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many incoming versions are added, amended, corrected, stale, the same."""
    return ledger.status_counts(ledger.reconcile(ledger.open_rows(views.history_rows(spark, d)), incoming_versions(spark, d)))


@query(
    f"""WITH {BEST}, p AS (SELECT * FROM hist WHERE valid_to IS NULL OR valid_to > valid_from), s AS (SELECT DISTINCT law_id, article_no, paragraph_no, valid_from AS day FROM p)
    SELECT 'start_without_exactly_one' AS check_name, count(*) AS n_bad FROM s WHERE (SELECT count(*) FROM p WHERE p.law_id = s.law_id AND p.article_no = s.article_no AND p.paragraph_no IS NOT DISTINCT FROM s.paragraph_no AND p.valid_from <= s.day AND (p.valid_to IS NULL OR p.valid_to > s.day)) <> 1"""
)
def boundary_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.boundary_checks(views.history_rows(spark, d).where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))


# --- changes in order


@query(
    f"""SELECT law_id, mst, enforcement_date, first_seq FROM (SELECT law_id, mst, arg_max_null(enforcement_date, change_no) AS enforcement_date, min(change_no) AS first_seq FROM ({FEED}) GROUP BY law_id, mst)
    ORDER BY enforcement_date NULLS FIRST, first_seq LIMIT 100"""
)
def next_changes(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred versions to be applied: by enforcement date, those of one day in the order of their first entry."""
    rows = ledger.first_position_last_value(feed(spark, d), ["law_id", "mst"], F.col("change_no"), ["enforcement_date"])
    return rows.orderBy("enforcement_date", "first_seq").limit(100)


@query(f"SELECT law_id, arg_max(mst, change_no) AS mst FROM ({FEED}) WHERE law_id IN (SELECT law_id FROM laws) AND mst IS NOT NULL GROUP BY law_id")
def current_versions(spark: SparkSession, d: str) -> DataFrame:
    """The present version id of every law that the feed names; looking one up for a law without any raises."""
    from lexstrata.sources.files import current_versions as resolve

    asked = table(spark, d, "laws").select("law_id").join(feed(spark, d).select("law_id"), "law_id", "left_semi")
    return resolve(asked, feed(spark, d).select("law_id", "mst", F.col("change_no").alias("seq")))


# --- index

_POINT = f"substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (position(substring(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12)"
_INDEX = f"""{ONE}, p AS (SELECT *, coalesce({_H}, false) AS is_now, sha1(unhex('{SPACE}') || encode(law_id || ':' || article_no || ':' || coalesce(paragraph_no, 0) || ':' || version_mst)) AS h FROM one),
kept AS (SELECT qdrant_point_id AS point, id AS article_pk FROM p WHERE is_now AND qdrant_point_id IS NOT NULL),
fresh AS (SELECT {_POINT} AS point, id AS article_pk FROM p WHERE is_now AND qdrant_point_id IS NULL AND id NOT IN (SELECT parent_article_pk FROM p WHERE parent_article_pk IS NOT NULL)),
idx AS (SELECT * FROM kept WHERE point NOT IN (SELECT point FROM fresh) UNION ALL SELECT * FROM fresh)"""


def _index_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = views.versions(spark, d, *KEY, "version_mst", "valid_from", "valid_to", "is_current", "parent_article_pk", index.POINT).drop("loaded_at")
    points = rows.where(F.col(index.POINT).isNotNull()).select(F.col(index.POINT).alias("point"), F.col("id").alias("article_pk"))
    return rows, points


@query(f"WITH {_INDEX} SELECT point, article_pk FROM idx")
def index_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """The index after a promotion: points of rows no longer current are gone, rows without one have got theirs."""
    return index.maintain(*_index_state(spark, d), day())[1].select("point", "article_pk")


@query(f"WITH {_INDEX} SELECT count(*) AS n_rows, count(i.point) AS n_points, count(DISTINCT i.point) AS n_distinct, count(*) FILTER (is_now) AS n_current FROM p LEFT JOIN idx i ON i.article_pk = p.id")
def index_write_back(spark: SparkSession, d: str) -> DataFrame:
    """The ledger with the points of the maintained index written back, and once more: nothing changes."""
    rows, points = index.maintain(*(cut_lineage(x) for x in index.maintain(*_index_state(spark, d), day())), day())
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(index.POINT).alias("n_points"), points.agg(F.count_distinct("point")).scalar().alias("n_distinct"), F.count_if("is_current").alias("n_current"))


@query(f"WITH {_INDEX} SELECT id FROM p WHERE is_now AND qdrant_point_id IS NULL AND id NOT IN (SELECT parent_article_pk FROM p WHERE parent_article_pk IS NOT NULL)")
def index_pending(spark: SparkSession, d: str) -> DataFrame:
    """Only what has no point yet would be encoded."""
    from lexstrata.operators.chunking import indexable

    return indexable(ledger.promote(_index_state(spark, d)[0], day()), index.POINT, pending_only=True).select("id")


@query("SELECT 1 AS no, true AS created, 0::BIGINT AS n_rows UNION ALL SELECT 2, false, 0")
def index_ensured(spark: SparkSession, d: str) -> DataFrame:
    """An index is created where there's none, and left alone where there's one."""
    root = scratch_path(spark, "index")
    made = [index.ensure(spark, root, _index_state(spark, d)[1].schema) for _ in range(2)]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(made, 1)], "no int, created boolean")
    return rows.withColumn("n_rows", spark.read.parquet(root).agg(F.count(F.lit(1))).scalar())


@query(f"WITH {_INDEX} SELECT point, article_pk FROM idx ORDER BY point LIMIT 100")
def index_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of a scan of the index in the order of its points."""
    return index_maintenance(spark, d).orderBy("point").limit(100)


# --- catalogue and graph


@query(
    f"""WITH {NODES}, old AS (SELECT * FROM nodes WHERE snapshot_date = (SELECT min(snapshot_date) FROM hs_node_snapshots))
    SELECT code, name_ko, name_en, is_leaf FROM now UNION ALL SELECT code, name_ko, name_en, is_leaf FROM old WHERE code NOT IN (SELECT code FROM now)"""
)
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot over the oldest: nodes that come in are replaced altogether, the others remain."""
    nodes = table(spark, d, "hs_node_snapshots")
    return catalog.upsert_nodes(views.snapshot_nodes(nodes, nodes.agg(F.min("snapshot_date"))), views.catalogue(spark, d)).select("code", "name_ko", "name_en", "is_leaf")


@query(f"WITH {NODES} SELECT code FROM now WHERE is_leaf ORDER BY code LIMIT 100")
def leaf_codes(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred leaves in order."""
    return views.catalogue(spark, d).where("is_leaf").select("code").orderBy("code").limit(100)


@query(f"WITH {NODES} SELECT code AS hs, t AS tpcd FROM now, (VALUES ('1'), ('2')) v(t) WHERE is_leaf AND NOT EXISTS (SELECT 1 FROM ccct_progress p WHERE nullif(regexp_replace(translate(p.hs, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '') = code AND trim(p.tpcd) = t) ORDER BY hs, tpcd LIMIT 50")
def sweep_next(spark: SparkSession, d: str) -> DataFrame:
    """The next fifty pairs of a sweep that was stopped."""
    from lexstrata.operators.requirements import sweep_todo

    return sweep_todo(views.catalogue(spark, d).where("is_leaf"), table(spark, d, "ccct_progress"), 50)


def _stored_edges(edges: DataFrame) -> DataFrame:
    """A stored graph as an earlier build left it: other counts, and an edge that isn't found any more."""
    stale = edges.sparkSession.createDataFrame([(-1, -2, "CITES", "gone", 1)], "src long, dst long, rel string, basis string, n long")
    return edges.withColumn("n", F.col("n") + 1).unionByName(stale)


@query(f"WITH {CITED} SELECT * FROM gedges UNION ALL SELECT -1, -2, 'CITES', 'gone', 1")
def graph_kept(spark: SparkSession, d: str) -> DataFrame:
    """A rebuild that keeps what is stored: edges found anew replace their old form, stale ones survive."""
    articles, laws = table(spark, d, "law_articles").where(F.col("deleted_at").isNull()), table(spark, d, "laws")
    nodes, _, edges = views.citation_graph(spark, d)
    return refgraph.build(articles, laws, (nodes, _stored_edges(edges)), keep=True)[1]


@query(f"WITH {CITED} SELECT 'all' AS parts, (SELECT count(*) FROM art) AS n_nodes, (SELECT count(*) FROM gedges) AS n_edges UNION ALL SELECT 'nodes', (SELECT count(*) FROM art), (SELECT count(*) + 1 FROM gedges) UNION ALL SELECT 'edges', (SELECT count(*) FROM art), (SELECT count(*) FROM gedges)")
def graph_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilds of the whole graph, of its nodes only, of its edges only."""
    articles, laws = table(spark, d, "law_articles").where(F.col("deleted_at").isNull()), table(spark, d, "laws")
    nodes, _, edges = views.citation_graph(spark, d)
    stored = cut_lineage(nodes), cut_lineage(_stored_edges(edges))
    out = []
    for parts in ("all", "nodes", "edges"):
        n, e = refgraph.build(articles, laws, stored, parts=parts)
        out.append(n.agg(F.count(F.lit(1)).alias("n_nodes")).select(F.lit(parts).alias("parts"), "n_nodes", e.agg(F.count(F.lit(1))).scalar().alias("n_edges")))
    return reduce(DataFrame.unionByName, out)


def _apart(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM (({a} EXCEPT {b}) UNION ALL ({b} EXCEPT {a})))"


_WHOLE = f"SELECT DISTINCT id FROM ({LIVE}) WHERE is_current AND paragraph_no IS NULL"


@query(
    f"""WITH {CITED}, {ONE}, led AS (SELECT id FROM one WHERE is_current AND id NOT IN (SELECT parent_article_pk FROM one WHERE parent_article_pk IS NOT NULL))
    SELECT 'graph_nodes' AS check_name, {_apart("SELECT id FROM art", _WHOLE)} AS n_bad
    UNION ALL SELECT 'index_ids', {_apart("SELECT id FROM one WHERE qdrant_point_id IS NOT NULL", "SELECT id FROM led")}
    UNION ALL SELECT 'sweep_products', {_apart("SELECT DISTINCT nullif(regexp_replace(translate(hs, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '') AS hs FROM ccct_progress", "SELECT DISTINCT nullif(regexp_replace(translate(hs, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '') AS hs FROM requires_edges")}
    UNION ALL SELECT 'laws', {_apart("SELECT DISTINCT law_id FROM laws", "SELECT DISTINCT law_id FROM law_articles")}"""
)
def store_differences(spark: SparkSession, d: str) -> DataFrame:
    """What only one of two stores has: graph and ledger, index and ledger, sweep and edges, laws and ledger."""
    from lexstrata.operators.chunking import indexable

    rows, points = _index_state(spark, d)
    whole = views.live(spark, d).where(F.col("is_current") & F.col("paragraph_no").isNull()).select("id")
    nodes = views.citation_graph(spark, d)[0].select(F.col("article_pk").alias("id"))
    codes = lambda name: table(spark, d, name).select(text.digits_of("hs").alias("hs"))
    return reduce(
        DataFrame.unionByName,
        [
            checks.both_ways("graph_nodes", nodes, whole, ["id"]),
            checks.both_ways("index_ids", points.select(F.col("article_pk").alias("id")), indexable(rows).select("id"), ["id"]),
            checks.both_ways("sweep_products", codes("ccct_progress"), codes("requires_edges"), ["hs"]),
            checks.both_ways("laws", table(spark, d, "laws"), table(spark, d, "law_articles"), ["law_id"]),
        ],
    )
