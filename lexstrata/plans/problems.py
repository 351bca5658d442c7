"""Queries of the general problems (2, 4, 5, 6, 7) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions.text import digits_of, is_blank, trim_any
from lexstrata.operators import changefeed, history, orphans, snapdiff, variants
from lexstrata.plans import body_sql
from lexstrata.session import scratch_path, table, written
from lexstrata.streaming import sync

# --- 2: references to records that do not exist


def article_parent_orphans(spark: SparkSession, d: str) -> DataFrame:
    ids = (
        table(spark, d, "law_articles")
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("loaded_at").alias("born"), F.min("deleted_at").alias("gone"), F.collect_set("parent_article_pk").alias("parents"))
    )
    refs = ids.select(F.lit("law_articles.parent_article_pk").alias("ref_name"), F.col("id").alias("row_id"), F.explode("parents").alias("key"), F.col("born").alias("at"))
    return orphans.find_orphans(refs, orphans.parent_intervals(ids, F.col("id"), F.col("born"), F.col("gone")))


def catalogue_orphans(spark: SparkSession, d: str) -> DataFrame:
    sweeps = table(spark, d, "ccct_progress").where(~is_blank("hs"))
    # A code without any digit names nothing: the empty key is never in a snapshot.
    refs = sweeps.select(F.lit("ccct_progress.hs").alias("ref_name"), F.col("rec_no").alias("row_id"), F.coalesce(digits_of("hs"), F.lit("")).alias("key"), F.col("swept_at").alias("at"))
    return orphans.find_orphans(refs, orphans.presence_intervals(table(spark, d, "hs_node_snapshots"), digits_of("code"), "snapshot_date"))


def law_code_orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "requires_edges").where(~is_blank("law_code"))
    refs = edges.select(F.lit("requires_edges.law_code").alias("ref_name"), F.col("edge_id").alias("row_id"), trim_any("law_code").alias("key"), F.col("loaded_at").alias("at"))
    laws = table(spark, d, "confirming_laws")
    return orphans.find_orphans(refs, orphans.parent_intervals(laws, trim_any("code"), F.col("created_at"), F.col("removed_at")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return article_parent_orphans(spark, d).unionByName(catalogue_orphans(spark, d)).unionByName(law_code_orphans(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, d))


_DIGITS = "nullif(regexp_replace(translate({c}, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '')"
_TRIM = r"regexp_replace({c}, '^[\s\pZ\x{{1C}}-\x{{1F}}\x{{85}}]+|[\s\pZ\x{{1C}}-\x{{1F}}\x{{85}}]+$', '', 'g')"

P2_SQL = rf"""
WITH art AS (SELECT id, min(loaded_at) AS born, min(deleted_at) AS gone FROM law_articles WHERE id IS NOT NULL GROUP BY id),
a AS (
  SELECT DISTINCT 'law_articles.parent_article_pk' AS ref_name, c.id AS row_id,
    CASE WHEN p.id IS NULL THEN 'missing' WHEN p.born > me.born THEN 'late' WHEN p.gone <= me.born THEN 'deleted' END AS kind, me.born AS seen_at
  FROM law_articles c JOIN art me ON me.id = c.id LEFT JOIN art p ON p.id = c.parent_article_pk WHERE c.parent_article_pk IS NOT NULL),
h AS (SELECT DISTINCT snapshot_date AS day, {_DIGITS.format(c="code")} AS code FROM hs_node_snapshots),
s AS (SELECT rec_no, swept_at, coalesce({_DIGITS.format(c="hs")}, '') AS code FROM ccct_progress WHERE {_TRIM.format(c="hs")} <> ''),
sn AS (SELECT s.*, (SELECT max(day) FROM h WHERE day <= swept_at) AS newest FROM s),
g AS (SELECT code, list(day) AS days FROM h WHERE code IS NOT NULL GROUP BY code),
b AS (
  SELECT 'ccct_progress.hs' AS ref_name, rec_no AS row_id,
    CASE WHEN list_contains(g.days, newest) THEN NULL WHEN len(list_filter(g.days, lambda x: x < newest)) > 0 THEN 'deleted'
         WHEN len(list_filter(g.days, lambda x: x > swept_at)) > 0 THEN 'late' ELSE 'missing' END AS kind, swept_at AS seen_at
  FROM sn LEFT JOIN g ON g.code = sn.code),
e AS (SELECT edge_id, loaded_at, {_TRIM.format(c="law_code")} AS code FROM requires_edges),
c AS (
  SELECT 'requires_edges.law_code' AS ref_name, edge_id AS row_id,
    CASE WHEN l.code IS NULL THEN 'missing' WHEN l.created_at > e.loaded_at THEN 'late' WHEN l.removed_at <= e.loaded_at THEN 'deleted' END AS kind, loaded_at AS seen_at
  FROM e LEFT JOIN confirming_laws l ON l.code = e.code WHERE e.code <> '')
SELECT DISTINCT ref_name, row_id, kind, strftime(seen_at, '%Y-%m') AS period
FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE kind IS NOT NULL
"""

# --- 4: what changed between full snapshots


def hs_rows(spark: SparkSession, d: str) -> DataFrame:
    return snapdiff.latest_rows(table(spark, d, "hs_node_snapshots"), digits_of("code"), "snapshot_date", F.col("name_ko"), F.col("loaded_at"), [F.col("row_id")])


def article_rows(spark: SparkSession, d: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    key = F.concat_ws(":", F.coalesce("law_id", F.lit("0")), zero("article_no"), zero("paragraph_no"))
    return snapdiff.latest_rows(table(spark, d, "article_snapshots"), key, "snapshot_date", F.col("content_hash"), F.col("loaded_at"))


P4_TABLES = (("hs_node_snapshots", hs_rows), ("article_snapshots", article_rows))


def _diffs(spark: SparkSession, d: str, known) -> DataFrame:
    """known: (rows, days, buckets) to key ordinals."""
    parts = []
    for name, rows in P4_TABLES:
        days, buckets = table(spark, d, name).select(F.col("snapshot_date").alias("day")), snapdiff.bucket_count(table(spark, d, name))
        latest = rows(spark, d)
        diff = snapdiff.snapshot_changes(latest, days, buckets, known(latest, days, buckets))
        parts.append(diff.select(F.lit(name).alias("src"), F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "rec_key", "change"))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """A first run: no ordinals are known yet, each bucket numbers its own keys."""
    return _diffs(spark, d, lambda rows, days, buckets: None)


def _snapshots_before(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the earlier half of the snapshots, by the middle of the time between the first and the last."""
    middle = days.agg(F.date_add(F.min("day"), (F.date_diff(F.max("day"), F.min("day")) / 2).cast("int"))).scalar()
    return rows.where(F.col("day") <= middle)


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """A later run: the ordinals that the first snapshots gave are written, extended by the new keys, written, and used."""

    def known(rows: DataFrame, days: DataFrame, buckets: int) -> DataFrame:
        first = written(snapdiff.key_ordinals(_snapshots_before(rows, days), buckets), "ordinals")
        return written(snapdiff.key_ordinals(rows, buckets, first), "ordinals")

    return _diffs(spark, d, known)


def p4_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of persistent ordinals: keys, keys that a later run numbered anew or twice, ordinals beyond the number of a bucket's keys."""
    parts = []
    for name, rows in P4_TABLES:
        days, buckets = table(spark, d, name).select(F.col("snapshot_date").alias("day")), snapdiff.bucket_count(table(spark, d, name))
        latest = rows(spark, d)
        first = written(snapdiff.key_ordinals(_snapshots_before(latest, days), buckets), "ordinals")
        then = written(snapdiff.key_ordinals(latest, buckets, first), "ordinals")
        moved = first.join(then, ["key", "bucket", "ordinal"], "left_anti").agg(F.count(F.lit(1)).alias("n_moved"))
        sizes = then.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ordinal").alias("d"), F.max("ordinal").alias("m"))
        sizes = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("n_twice"), F.coalesce(F.sum(F.col("m") + 1 - F.col("n")), F.lit(0)).alias("n_spare"))
        parts.append(sizes.select(F.lit(name).alias("src"), "*", moved.scalar().alias("n_moved")))
    return parts[0].unionByName(parts[1])


P4_SQL = rf"""
WITH r AS (
  SELECT 'hs_node_snapshots' AS src, snapshot_date AS day, {_DIGITS.format(c="code")} AS k, name_ko AS v, loaded_at, row_id AS tie FROM hs_node_snapshots
  UNION ALL
  SELECT 'article_snapshots', snapshot_date, coalesce(law_id, '0') || ':' || coalesce(article_no, 0) || ':' || coalesce(paragraph_no, 0), content_hash, loaded_at, 0 FROM article_snapshots),
days AS (SELECT src, day, row_number() OVER (PARTITION BY src ORDER BY day) AS no FROM (SELECT DISTINCT src, day FROM r WHERE day IS NOT NULL)),
l AS (SELECT r.src, no, k, v FROM r JOIN days USING (src, day) WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r.src, no, k ORDER BY loaded_at DESC, tie DESC, v DESC) = 1),
d AS (
  SELECT coalesce(a.src, b.src) AS src, coalesce(b.no, a.no + 1) AS no, coalesce(a.k, b.k) AS k,
    CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change
  FROM l a FULL JOIN l b ON a.src = b.src AND a.k = b.k AND b.no = a.no + 1)
SELECT d.src, strftime(days.day, '%Y-%m-%d') AS snapshot_date, k AS rec_key, change
FROM d JOIN days ON days.src = d.src AND days.no = d.no WHERE d.no > 1 AND change IS NOT NULL
"""

P4_ORDINALS_SQL = f"""
SELECT 'hs_node_snapshots' AS src, count(DISTINCT {_DIGITS.format(c="code")}) AS n_keys, 0::BIGINT AS n_twice, 0::BIGINT AS n_spare, 0::BIGINT AS n_moved FROM hs_node_snapshots WHERE snapshot_date IS NOT NULL
UNION ALL SELECT 'article_snapshots', count(DISTINCT coalesce(law_id, '0') || ':' || coalesce(article_no, 0) || ':' || coalesce(paragraph_no, 0)), 0, 0, 0 FROM article_snapshots WHERE snapshot_date IS NOT NULL
"""

# --- 5: history of changing attributes

ARTICLE_KEY = ["law_id", "article_no", "paragraph_no"]


WATCHED = ["content_hash", "title"]
CARRIED = ["valid_to", "version_mst"]


def live_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_articles").where(F.col("deleted_at").isNull()).withColumn("paragraph_no", F.coalesce("paragraph_no", F.lit(0)))


def live_deliveries(rows: DataFrame) -> DataFrame:
    return history.first_deliveries(rows, ARTICLE_KEY, "valid_from", "id", "loaded_at", [*CARRIED, *WATCHED])


def live_versions(spark: SparkSession, d: str) -> DataFrame:
    return history.counting(live_deliveries(live_rows(spark, d)), ARTICLE_KEY, "valid_from")


def satellites(versions: DataFrame) -> list[list[str]]:
    """The attributes of each satellite, split by how often they change from one version to the next."""
    rates = history.change_rates(versions, ARTICLE_KEY, "valid_from", WATCHED)
    return [g for g in history.split_by_rate(rates).values() if g]


def attribute_periods(spark: SparkSession, d: str, attribute: str) -> DataFrame:
    """All versions loaded at once into the satellite that has the attribute, and its periods."""
    versions = written(live_versions(spark, d), "versions")  # read twice: for the rates and for the satellite
    (group,) = [g for g in satellites(versions) if attribute in g]
    sat = history.satellite_rows(None, versions, ARTICLE_KEY, "valid_from", group, CARRIED, counted=True)
    return history.periods(sat, ARTICLE_KEY, "valid_from", "valid_to", [attribute], one_load=True)


def _dated(view: DataFrame) -> DataFrame:
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return view.select(*ARTICLE_KEY, "version_mst", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _dated(attribute_periods(spark, d, "content_hash"))


def p5_titles(spark: SparkSession, d: str) -> DataFrame:
    """The slowly changing satellite: the periods of each article's title."""
    return attribute_periods(spark, d, "title").select(*ARTICLE_KEY, "title", "valid_from", "valid_to")


def p5_loads(spark: SparkSession, d: str, cuts: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(satellite of the content, what was appended by each load): the rows in several loads by load time, each appending to what the earlier ones left.

    cuts: times between the loads; by default two that divide the time from first to last in three.
    """
    rows = live_rows(spark, d)
    lo, hi = (rows.agg(F.unix_micros(f(F.col("loaded_at").cast("timestamp")))).scalar() for f in (F.min, F.max))
    cuts = [F.timestamp_micros((lo + (hi - lo) * k / 3).cast("long")).cast("timestamp_ntz") for k in (1, 2)] if cuts is None else cuts
    bounds = [None, *cuts, None]
    (group,) = [g for g in satellites(live_versions(spark, d)) if "content_hash" in g]
    sat = seen = loads = None
    for no, (a, b) in enumerate(zip(bounds, bounds[1:])):
        load = rows if a is None else rows.where(F.col("loaded_at") >= a)
        load = load if b is None else load.where(F.coalesce(F.col("loaded_at") < b, F.lit(True)) if a is None else F.col("loaded_at") < b)
        fresh = history.new_deliveries(seen, live_deliveries(load), ARTICLE_KEY, "valid_from")
        more = written(history.satellite_rows(sat, fresh, ARTICLE_KEY, "valid_from", group, CARRIED))
        ids = written(fresh.select("row_id", *ARTICLE_KEY, "valid_from"))
        counts = more.agg(F.lit(no).alias("load_no"), F.count(F.lit(1)).alias("n_appended"))
        sat, seen, loads = (new if old is None else old.unionByName(new) for old, new in ((sat, more), (seen, ids), (loads, counts)))
    return sat, loads


def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The history built by three loads that only append: what p5_found gives at once."""
    return _dated(history.periods(p5_loads(spark, d)[0], ARTICLE_KEY, "valid_from", "valid_to", ["content_hash"]))


def p5_appended(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each of the three loads appended."""
    return p5_loads(spark, d)[1]


_P5 = """
WITH live AS (SELECT *, coalesce(paragraph_no, 0) AS para FROM law_articles WHERE deleted_at IS NULL AND valid_from IS NOT NULL),
one AS (SELECT *, min(loaded_at) OVER (PARTITION BY id) AS first_loaded FROM live),
best AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY law_id, article_no, para, valid_from ORDER BY first_loaded DESC, id DESC) = 1),
ended AS (SELECT *, least(valid_to, lead(valid_from) OVER w) AS ends FROM best WINDOW w AS (PARTITION BY law_id, article_no, para ORDER BY valid_from)),
per AS (SELECT * FROM ended WHERE ends IS NULL OR ends > valid_from),
mark AS (SELECT *, CASE WHEN lag(ends) OVER w = valid_from AND lag({v}) OVER w IS NOT DISTINCT FROM {v} THEN 0 ELSE 1 END AS fresh FROM per WINDOW w AS (PARTITION BY law_id, article_no, para ORDER BY valid_from)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY law_id, article_no, para ORDER BY valid_from) AS run FROM mark)
"""

P5_SQL = (
    _P5.format(v="content_hash")
    + """
SELECT law_id, article_no, para AS paragraph_no, arg_min(version_mst, valid_from) AS version_mst, strftime(min(valid_from), '%Y-%m-%d') AS valid_from,
  coalesce(strftime(CASE WHEN count(ends) = count(*) THEN max(ends) END, '%Y-%m-%d'), '') AS valid_to
FROM runs GROUP BY law_id, article_no, para, run
"""
)
P5_TITLES_SQL = (
    _P5.format(v="title")
    + """
SELECT law_id, article_no, para AS paragraph_no, any_value(title) AS title, min(valid_from) AS valid_from, CASE WHEN count(ends) = count(*) THEN max(ends) END AS valid_to
FROM runs GROUP BY law_id, article_no, para, run
"""
)

_P5_LIVE = "SELECT *, coalesce(paragraph_no, 0) AS para FROM law_articles WHERE deleted_at IS NULL AND valid_from IS NOT NULL"
# A load appends the last loaded row of each start unless it equals the last of the loads before.
P5_APPENDED_SQL = f"""
WITH live AS ({_P5_LIVE}), t AS (SELECT epoch_us(min(loaded_at)) AS lo, epoch_us(max(loaded_at)) AS hi FROM live),
one AS (SELECT id, law_id, article_no, para, valid_from, min(loaded_at) AS loaded, arg_min({{'to': valid_to, 'mst': version_mst, 'hash': content_hash}}, loaded_at) AS v, any_value(title) AS title FROM live GROUP BY ALL),
nth AS (SELECT one.*, CASE WHEN epoch_us(loaded) < (lo + (hi - lo) / 3)::BIGINT THEN 0 WHEN epoch_us(loaded) < (lo + (hi - lo) * 2 / 3)::BIGINT THEN 1 ELSE 2 END AS load_no FROM one, t),
last AS (SELECT load_no, law_id, article_no, para, valid_from, arg_max(v, {{'a': loaded, 'b': id}}) AS v FROM nth GROUP BY ALL),
diff AS (SELECT load_no, v IS DISTINCT FROM lag(v) OVER w OR lag(load_no) OVER w IS NULL AS fresh FROM last WINDOW w AS (PARTITION BY law_id, article_no, para, valid_from ORDER BY load_no))
SELECT n::INT AS load_no, count(*) FILTER (fresh) AS n_appended FROM (SELECT unnest([0, 1, 2]) AS n) LEFT JOIN diff ON load_no = n GROUP BY n
"""

# --- 6: applying a stream of inserts, updates and deletes


def feed_parts() -> dict:
    date = F.regexp_replace(F.translate("enforcement_date", "０１２３４５６７８９", "0123456789"), "[^0-9]", "")
    return {
        "keys": {"law_id": trim_any("law_id"), "mst": trim_any("mst")},
        "seq": F.col("change_no"),
        "op": trim_any("op"),
        "fields": {"enforcement_date": date, "revision_type": trim_any("revision_type")},
    }


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    states = changefeed.apply_changes(table(spark, d, "ls_hst_inf"), **feed_parts())
    return changefeed.current_rows(states, ["law_id", "mst"], ["enforcement_date", "revision_type"])


P6_SQL = rf"""
WITH c AS (
  SELECT change_no AS n, upper({_TRIM.format(c="op")}) AS op, {_TRIM.format(c="law_id")} AS law_id, {_TRIM.format(c="mst")} AS mst,
    regexp_replace(enforcement_date, '[^0-9]', '', 'g') AS e, {_TRIM.format(c="revision_type")} AS r FROM ls_hst_inf),
last AS (SELECT law_id, mst, max(n) AS n, arg_max(op, n) AS op FROM c WHERE op IN ('I', 'D') GROUP BY law_id, mst),
f AS (SELECT c.law_id, c.mst, arg_max(e, c.n) FILTER (e IS NOT NULL) AS enforcement_date, arg_max(r, c.n) FILTER (r IS NOT NULL) AS revision_type
  FROM c JOIN last ON c.law_id = last.law_id AND c.mst = last.mst AND c.n >= last.n WHERE last.op = 'I' GROUP BY c.law_id, c.mst)
SELECT law_id, mst, enforcement_date, revision_type FROM f
"""

# --- 7: deeply nested records


def p7_nodes(spark: SparkSession, d: str) -> DataFrame:
    return variants.nested_nodes(table(spark, d, "law_bodies_raw"), "body_id", "body")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_nodes(spark, d).select(F.col("record_id").alias("body_id"), "node_level", *variants.PLACES).distinct()


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """All nodes with their parents, fields and texts, but for the automaton's states."""
    return p7_nodes(spark, d).drop("state").distinct()


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    """What the typed tables hold, routed there by one parse: rows, texts, parents and characters of each that isn't empty."""
    root = scratch_path(spark, "typed")
    variants.write_typed(p7_nodes(spark, d).distinct(), root)
    parts = []
    for name, t in variants.typed_tables(spark, root).items():
        if "/" in name:
            text = F.col("text") if "text" in t.columns else F.lit(None).cast("string")
            parent = F.col("parent_id") if "parent_id" in t.columns else F.lit(None).cast("string")
            parts.append(t.agg(F.count(F.lit(1)).alias("n_rows"), F.count(text).alias("n_texts"), F.count_distinct(parent).alias("n_parents"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts).where("n_rows > 0")


# White space anywhere in the text, raw or escaped, makes no difference to where objects stand.
_EACH = "CASE json_type({v}) WHEN 'OBJECT' THEN [{v}] WHEN 'ARRAY' THEN json_extract({v}, '$[*]') ELSE [] END"


def _level(name: str, source: str, holder: str, label: str, places: str) -> str:
    value = f"json_extract({holder}, '$.\"{label}\"')"
    return f"""{name} AS (SELECT * FROM (SELECT body_id, {places}unnest(xs) AS x, generate_subscripts(xs, 1) AS {name}_pos FROM (SELECT *, {_EACH.format(v=value)} AS xs FROM {source})) WHERE json_type(x) = 'OBJECT')"""


P7_SQL = rf"""
WITH body AS (SELECT DISTINCT body_id, regexp_replace(body, '(\\[nrtf]|[\s\pZ])+', '', 'g')::JSON AS j FROM law_bodies_raw WHERE json_valid(body)),
top AS (SELECT body_id, json_extract(j, '$."법령"."조문"') AS x FROM body),
{_level("jo", "top", "x", "조문단위", "")},
{_level("hang", "jo", "x", "항", "jo_pos, ")},
{_level("ho", "hang", "x", "호", "jo_pos, hang_pos, ")},
{_level("mok", "ho", "x", "목", "jo_pos, hang_pos, ho_pos, ")}
SELECT DISTINCT body_id, '조문단위' AS node_level, jo_pos::INT AS jo_pos, 0 AS hang_pos, 0 AS ho_pos, 0 AS mok_pos FROM jo
UNION ALL SELECT DISTINCT body_id, '항', jo_pos::INT, hang_pos::INT, 0, 0 FROM hang
UNION ALL SELECT DISTINCT body_id, '호', jo_pos::INT, hang_pos::INT, ho_pos::INT, 0 FROM ho
UNION ALL SELECT DISTINCT body_id, '목', jo_pos::INT, hang_pos::INT, ho_pos::INT, mok_pos::INT FROM mok
"""


def change_feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6 as a stream: the feed's files through the incremental job into a published state, and what exists in it."""
    root = scratch_path(spark, "feed")
    schema = table(spark, d, "ls_hst_inf").schema
    sync.apply_feed(spark, f"{d}/ls_hst_inf.parquet*", schema, f"{root}/state", f"{root}/progress", feed_parts).awaitTermination()
    keys, fields = ["law_id", "mst"], ["enforcement_date", "revision_type"]
    return changefeed.current_rows(changefeed.read_state(spark, f"{root}/state", keys, fields), keys, fields)


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p4_found, p4_incremental, p4_ordinals, p5_found, p5_titles, p5_incremental, p5_appended, p6_found, p7_found, p7_nodes, p7_links, p7_tables, change_feed_stream)}
SQL = {
    "p2_found": P2_SQL,
    "p2_report": f"SELECT ref_name, period, kind, count(*) AS n_rows FROM ({P2_SQL}) GROUP BY ALL",
    "p4_found": P4_SQL,
    "p4_incremental": P4_SQL,
    "p4_ordinals": P4_ORDINALS_SQL,
    "p5_found": P5_SQL,
    "p5_titles": P5_TITLES_SQL,
    "p5_incremental": P5_SQL,
    "p5_appended": P5_APPENDED_SQL,
    "p6_found": P6_SQL,
    "change_feed_stream": P6_SQL,
    "p7_found": P7_SQL,
    "p7_links": body_sql.LINKS_SQL,
    "p7_tables": body_sql.TABLES_SQL,
}
