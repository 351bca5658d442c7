"""Queries of the engine's own operators over the whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions import lexical, temporal, text
from lexstrata.operators import catalog, checks, chunking, history, ledger, refgraph, requirements, search, snapdiff
from lexstrata.plans import body_sql, views
from lexstrata.session import scratch_path, spread, table, written

AS_OF = "2024-06-30"
QUERY = "수입물품의 통관 신고 보세구역"
KEY = ledger.KEY

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def day(iso: str = AS_OF) -> Column:
    return F.lit(iso).cast("date")


# --- SQL shared by several queries
LIVE = "SELECT * FROM law_articles WHERE deleted_at IS NULL AND id IS NOT NULL"
BEST = f"""best AS (
  SELECT * FROM (SELECT *, min(loaded_at) OVER (PARTITION BY id) AS first_loaded FROM ({LIVE}))
  QUALIFY row_number() OVER (PARTITION BY law_id, article_no, paragraph_no, valid_from ORDER BY first_loaded DESC, id DESC, loaded_at) = 1),
hist AS (SELECT law_id, article_no, paragraph_no, valid_from, id, content_hash, version_mst, title, least(valid_to, lead(valid_from) OVER (PARTITION BY law_id, article_no, paragraph_no ORDER BY valid_from)) AS valid_to FROM best)"""
SNAP = """snap AS (
  SELECT law_id, article_no, paragraph_no, enforcement_date AS valid_from, content_hash FROM article_snapshots
  WHERE snapshot_date = (SELECT max(snapshot_date) FROM article_snapshots)
  QUALIFY row_number() OVER (PARTITION BY law_id, article_no, paragraph_no ORDER BY loaded_at DESC, content_hash DESC) = 1)"""
HOLDS = "valid_from <= DATE '{d}' AND (valid_to IS NULL OR valid_to > DATE '{d}')"
DIGITS = "nullif(regexp_replace(translate({c}, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '')"
NODES = f"""nodes AS (
  SELECT {DIGITS.format(c="code")} AS code, name_ko, name_en, is_leaf, hs6, heading4, chapter2, snapshot_date FROM hs_node_snapshots
  WHERE {DIGITS.format(c="code")} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_date, {DIGITS.format(c="code")} ORDER BY loaded_at DESC, row_id DESC) = 1),
now AS (SELECT * FROM nodes WHERE snapshot_date = (SELECT max(snapshot_date) FROM hs_node_snapshots))"""
TOKENS = "flatten(list_transform(regexp_extract_all(lower({c}), '[가-힣]+|[a-z0-9]+'), lambda r: CASE WHEN r >= '가' AND length(r) > 1 THEN list_concat([r], list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) ELSE [r] END))"
WEIGHT = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 256.0))"
POSTED = f"""tok AS (SELECT doc_id, {TOKENS.format(c="text")} AS toks FROM documents),
posted AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS token FROM tok) GROUP BY ALL)"""
TRIM = r"regexp_replace({c}, '^[\s\pZ\x{{85}}]+|[\s\pZ\x{{85}}]+$', '', 'g')"
ITEMS = f"""items AS (
  SELECT DISTINCT {DIGITS.format(c="hs")} AS hs, CASE {TRIM.format(c="tpcd")} WHEN '1' THEN '수출' WHEN '2' THEN '수입' END AS trade_type, swept_at, rec_no, place,
    {", ".join(f"coalesce({TRIM.format(c='i.' + f)}, '') AS {n}" for f, n in (("dcerCfrmLworCd", "law_code"), ("dcerCfrmLworNm", "law_name"), ("reqApreIttCd", "agency_code"), ("reqApreIttNm", "agency_name"), ("aplyStrtDt", "valid_from"), ("reqCfrmIstmNm", "document"), ("bfhnAffcRtmTpcd", "rtm_tpcd")))}
  FROM (SELECT *, unnest(items) AS i, generate_subscripts(items, 1) AS place FROM ccct_progress WHERE items IS NOT NULL) WHERE i IS NOT NULL),
known AS (SELECT * FROM items WHERE hs IN (SELECT code FROM now)),
edges AS (SELECT hs, law_code, trade_type, e.valid_from, e.document, e.rtm_tpcd FROM (SELECT hs, law_code, trade_type, arg_max({{'valid_from': valid_from, 'document': document, 'rtm_tpcd': rtm_tpcd}}, {{'a': swept_at, 'b': rec_no, 'c': place}}) AS e FROM known GROUP BY ALL)),
lawn AS (SELECT law_code, arg_min(law_name, {{'a': swept_at, 'b': rec_no, 'c': place}}) AS law_name FROM known GROUP BY ALL),
agn AS (SELECT agency_code, arg_min(agency_name, {{'a': swept_at, 'b': rec_no, 'c': place}}) AS agency_name FROM known GROUP BY ALL),
per AS (SELECT law_code, list_sort(list(DISTINCT agency_name)) AS agencies FROM (SELECT DISTINCT law_code, agency_code FROM known) JOIN agn USING (agency_code) GROUP BY law_code),
paths AS (SELECT edges.*, law_name, agencies FROM edges JOIN lawn USING (law_code) JOIN per USING (law_code) WHERE law_name <> '')"""
FAMILY = """fam0 AS (SELECT DISTINCT law_id, law_name, hierarchy, regexp_replace(law_name, ' (시행령|시행규칙)$', '') AS base FROM laws WHERE hierarchy IN ('법률', '시행령', '시행규칙')),
fam AS (SELECT *, CASE hierarchy WHEN '법률' THEN 1 WHEN '시행령' THEN 2 ELSE 3 END AS rank,
  min(law_id) FILTER (hierarchy = '법률') OVER (PARTITION BY base) AS act_id, min(law_id) FILTER (hierarchy = '시행령') OVER (PARTITION BY base) AS decree_id, min(law_id) FILTER (hierarchy = '시행규칙') OVER (PARTITION BY base) AS rule_id FROM fam0)"""
_ART = r"제(\p{Nd}+)조(?:의(\p{Nd}+))?"
_S = r"[\s\pZ\x{85}]"
CITED = rf"""{FAMILY},
art AS (SELECT law_id, article_no, max(id) AS id, arg_max(title, id) AS title, arg_max(content, id) AS content FROM law_articles WHERE deleted_at IS NULL AND is_current AND paragraph_no IS NULL AND law_id IN (SELECT law_id FROM laws) GROUP BY ALL),
body AS (SELECT art.id, art.law_id, article_no, base, act_id, decree_id, rule_id,
  replace(replace(replace(replace(CASE WHEN content LIKE '[%' THEN CASE WHEN contains(content, chr(10)) THEN substring(content, position(chr(10) IN content) + 1) ELSE '' END ELSE content END, '「', ''), '」', ''), base || ' 시행규칙', base || '시행규칙'), base || ' 시행령', base || '시행령') AS b,
  '(?:(?:' || base || '시행규칙|' || base || '시행령|이{_S}?법|같은{_S}?법|이{_S}?영|같은{_S}?영|시행규칙|시행령|[가-힣]{{2,12}}법|법|영|규칙){_S}*)?{_ART}' AS p
  FROM art JOIN fam USING (law_id)),
hit AS (SELECT *, unnest(h) AS hit, generate_subscripts(h, 1) AS place FROM (SELECT *, regexp_extract_all(b, p) AS h FROM body) WHERE len(h) > 0),
word AS (SELECT *, replace(regexp_replace(regexp_extract(hit, '^((?s:.*)){_ART}$', 1), '{_S}+$', ''), ' ', '') AS w,
  translate(regexp_extract(hit, '^((?s:.*)){_ART}$', 2), '０１２３４５６７８９', '0123456789')::INT * 100 + coalesce(nullif(translate(regexp_extract(hit, '^((?s:.*)){_ART}$', 3), '０１２３４５６７８９', '0123456789'), '')::INT, 0) AS dst_article FROM hit),
tgt AS (SELECT *, CASE WHEN w IN ('', '이법', '같은법', '이영', '같은영') THEN law_id WHEN w LIKE '%' || base || '시행규칙' OR w IN ('시행규칙', '규칙') THEN rule_id
  WHEN w LIKE '%' || base || '시행령' OR w IN ('시행령', '영') THEN decree_id WHEN w LIKE '%' || base OR w = '법' THEN act_id END AS dst_law FROM word),
refs AS (SELECT id AS src_id, law_id AS src_law, article_no AS src_article, dst_law, dst_article, trim(arg_min(hit, place)) AS basis FROM tgt
  WHERE dst_law IS NOT NULL AND NOT (dst_law = law_id AND dst_article = article_no) GROUP BY ALL),
met AS (SELECT refs.*, a.id AS dst_id, f1.rank AS r1, f2.rank AS r2 FROM refs JOIN art a ON a.law_id = dst_law AND a.article_no = dst_article JOIN fam f1 ON f1.law_id = src_law JOIN fam f2 ON f2.law_id = dst_law),
gedges AS (SELECT CASE WHEN src_law = dst_law OR r1 < r2 THEN src_id ELSE dst_id END AS src, CASE WHEN src_law = dst_law OR r1 < r2 THEN dst_id ELSE src_id END AS dst, CASE WHEN src_law = dst_law THEN 'CITES' ELSE 'DELEGATES' END AS rel,
  arg_min(basis, {{'a': src_law, 'b': src_article, 'c': dst_article, 'd': src_id}}) AS basis, count(*) AS n FROM met GROUP BY ALL)"""

# --- temporal ledger


@query(f"SELECT DISTINCT id, law_id, article_no, paragraph_no, version_mst FROM ({LIVE}) WHERE {HOLDS.format(d=AS_OF)}")
def temporal_as_of(spark: SparkSession, d: str) -> DataFrame:
    rows = views.slim_ledger(spark, d, *KEY, "version_mst", "valid_from", "valid_to")
    return rows.where(temporal.in_force(day())).select("id", *KEY, "version_mst")


@query(f"WITH {BEST} SELECT law_id, article_no, paragraph_no, id, version_mst, valid_from, valid_to FROM hist WHERE {HOLDS.format(d='2020-01-01')}")
def resolve_as_of(spark: SparkSession, d: str) -> DataFrame:
    return views.history_rows(spark, d).where(temporal.in_force(day("2020-01-01"))).select(*KEY, "id", "version_mst", "valid_from", "valid_to")


@query(
    f"""SELECT count(*) FILTER ({HOLDS.format(d=AS_OF)}) AS n_current, count(*) FILTER (valid_to IS NULL) AS n_latest, count(*) FILTER (valid_to IS NULL AND {HOLDS.format(d=AS_OF)}) AS n_both, count(*) FILTER (is_current) AS n_flagged
    FROM (SELECT DISTINCT id, valid_from, valid_to, is_current FROM ({LIVE}))"""
)
def temporal_current_vs_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = views.slim_ledger(spark, d, "valid_from", "valid_to", "is_current")
    now, latest = temporal.in_force(day()), F.col("valid_to").isNull()
    return rows.agg(F.count_if(now).alias("n_current"), F.count_if(latest).alias("n_latest"), F.count_if(now & latest).alias("n_both"), F.count_if("is_current").alias("n_flagged"))


@query(
    f"""WITH {BEST}, b AS (SELECT DISTINCT law_id, article_no, paragraph_no, unnest([valid_from, valid_to]) AS day FROM hist)
    SELECT b.law_id, b.article_no, b.paragraph_no, b.day, count(*) FILTER (h.valid_from <= day AND (h.valid_to IS NULL OR h.valid_to > day)) AS n_hits
    FROM b JOIN hist h ON h.law_id = b.law_id AND h.article_no = b.article_no AND h.paragraph_no IS NOT DISTINCT FROM b.paragraph_no WHERE day IS NOT NULL GROUP BY ALL"""
)
def as_of_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return ledger.boundary_hits(views.history_rows(spark, d).where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))


_SPANS = "s AS (SELECT DISTINCT id, law_id, article_no, paragraph_no, valid_from, valid_to FROM (" + LIVE + ") WHERE valid_to IS NULL OR valid_to > valid_from)"


@query(
    f"""WITH {_SPANS} SELECT law_id, article_no, paragraph_no, id FROM s WHERE EXISTS (SELECT 1 FROM s e WHERE e.law_id = s.law_id AND e.article_no = s.article_no AND e.paragraph_no IS NOT DISTINCT FROM s.paragraph_no
    AND (e.valid_from < s.valid_from OR (e.valid_from = s.valid_from AND e.id < s.id)) AND (e.valid_to IS NULL OR e.valid_to > s.valid_from))"""
)
def interval_overlap_window(spark: SparkSession, d: str) -> DataFrame:
    return ledger.overlap_flags(views.slim_ledger(spark, d, *KEY, "valid_from", "valid_to"))


@query(
    f"""WITH {_SPANS} SELECT a.law_id, a.article_no, a.paragraph_no, count(*) AS n_pairs FROM s a JOIN s b ON a.law_id = b.law_id AND a.article_no = b.article_no AND a.paragraph_no IS NOT DISTINCT FROM b.paragraph_no AND a.id < b.id
    AND a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31') GROUP BY ALL"""
)
def interval_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.overlap_counts(views.slim_ledger(spark, d, *KEY, "valid_from", "valid_to"))


@query(
    """WITH v AS (SELECT law_id, article_no, paragraph_no, enforcement_date AS valid_from, arg_max(content_hash, {'a': snapshot_date, 'b': loaded_at, 'c': content_hash}) AS content_hash FROM article_snapshots GROUP BY ALL),
    k AS (SELECT *, lag(content_hash) OVER w IS DISTINCT FROM content_hash AS fresh FROM v WINDOW w AS (PARTITION BY law_id, article_no, paragraph_no ORDER BY valid_from))
    SELECT law_id, article_no, paragraph_no, valid_from, content_hash, lead(valid_from) OVER (PARTITION BY law_id, article_no, paragraph_no ORDER BY valid_from) AS valid_to FROM k WHERE fresh"""
)
def scd2_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article_snapshots").withColumnRenamed("enforcement_date", "valid_from")
    one = rows.groupBy(*KEY, "valid_from").agg(F.max_by("content_hash", F.struct("snapshot_date", "loaded_at", "content_hash")).alias("content_hash"))
    return ledger.derive_ledger(one)


def incoming_versions(spark: SparkSession, d: str) -> DataFrame:
    """The newest full snapshot of the articles, one row a key."""
    snaps = table(spark, d, "article_snapshots")
    rows = snaps.where(F.col("snapshot_date") == snaps.agg(F.max("snapshot_date")).scalar())
    last = F.max_by(F.struct(F.col("enforcement_date").alias("valid_from"), "content_hash"), F.struct("loaded_at", "content_hash"))
    return rows.groupBy(*KEY).agg(last.alias("r")).select(*KEY, "r.*")


@query(
    f"""WITH {BEST}, {SNAP} SELECT n.law_id, n.article_no, n.paragraph_no, n.valid_from AS new_from, o.valid_from AS old_from,
    CASE WHEN o.valid_from IS NULL THEN 'added' WHEN n.content_hash = o.content_hash THEN 'same' WHEN n.valid_from < o.valid_from THEN 'stale' WHEN n.valid_from = o.valid_from THEN 'corrected' ELSE 'amended' END AS status
    FROM snap n LEFT JOIN (SELECT * FROM hist WHERE valid_to IS NULL) o ON o.law_id = n.law_id AND o.article_no = n.article_no AND o.paragraph_no IS NOT DISTINCT FROM n.paragraph_no"""
)
def scd2_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return ledger.reconcile(ledger.open_rows(views.history_rows(spark, d)), incoming_versions(spark, d))


@query(
    f"""WITH {BEST}, {SNAP}, e AS (SELECT law_id, max(valid_from) AS effective_on FROM snap GROUP BY law_id)
    SELECT o.law_id, o.article_no, o.paragraph_no, o.valid_from, effective_on AS closes_on, o.valid_from >= effective_on AS conflict FROM (SELECT * FROM hist WHERE valid_to IS NULL) o JOIN e USING (law_id)
    WHERE NOT EXISTS (SELECT 1 FROM snap n WHERE o.law_id = n.law_id AND o.article_no = n.article_no AND o.paragraph_no IS NOT DISTINCT FROM n.paragraph_no)"""
)
def apply_version_removed(spark: SparkSession, d: str) -> DataFrame:
    new = incoming_versions(spark, d)
    effective = new.groupBy("law_id").agg(F.max("valid_from").alias("effective_on"))
    return ledger.removed_units(ledger.open_rows(views.history_rows(spark, d)), new, effective)


@query(f"SELECT count(*) FILTER (is_current AND valid_to <= DATE '{AS_OF}') AS demoted, count(*) FILTER (NOT is_current AND {HOLDS.format(d=AS_OF)}) AS promoted FROM (SELECT DISTINCT id, valid_from, valid_to, is_current FROM ({LIVE}))")
def promote_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.promote_counts(views.slim_ledger(spark, d, "valid_from", "valid_to", "is_current"), day())


@query(f"SELECT is_now, count(*) AS n_rows FROM (SELECT DISTINCT id, valid_from, valid_to, {HOLDS.format(d=AS_OF)} AS is_now FROM ({LIVE})) GROUP BY is_now")
def promoted_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.promote(views.slim_ledger(spark, d, "valid_from", "valid_to", "is_current"), day())
    return rows.groupBy(F.col("is_current").alias("is_now")).agg(F.count(F.lit(1)).alias("n_rows"))


# --- change feed and masters

_FEED = f"SELECT change_no, {TRIM.format(c='law_id')} AS law_id, {TRIM.format(c='mst')} AS mst, reg_dt, {TRIM.format(c='revision_type')} AS revision_type, regexp_replace(enforcement_date, '[^0-9]', '', 'g') AS enforcement_date FROM ls_hst_inf"


def feed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ls_hst_inf")
    return rows.select("change_no", text.trim_any("law_id").alias("law_id"), text.trim_any("mst").alias("mst"), "reg_dt", text.trim_any("revision_type").alias("revision_type"), F.regexp_replace("enforcement_date", "[^0-9]", "").alias("enforcement_date"))


@query(f"SELECT law_id, mst, arg_max_null(enforcement_date, change_no) AS enforcement_date, arg_max_null(revision_type, change_no) AS revision_type, min(change_no) AS first_seq FROM ({_FEED}) GROUP BY law_id, mst")
def change_feed_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ledger.first_position_last_value(feed(spark, d), ["law_id", "mst"], F.col("change_no"), ["enforcement_date", "revision_type"])


@query(
    f"""WITH f AS (SELECT strptime(reg_dt, '%Y%m%d')::DATE AS day, change_no FROM ({_FEED}))
    SELECT s.day, count(DISTINCT f.change_no) AS n_changes FROM (SELECT unnest(generate_series((SELECT min(day) FROM f), (SELECT max(day) FROM f), INTERVAL 1 DAY))::DATE AS day) s LEFT JOIN f ON f.day = s.day GROUP BY s.day"""
)
def day_spine(spark: SparkSession, d: str) -> DataFrame:
    rows = feed(spark, d).select(text.strict_date("reg_dt").alias("day"), "change_no")
    ends = rows.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return days.join(rows.groupBy("day").agg(F.count_distinct("change_no").alias("n_changes")), "day", "left").select("day", F.coalesce("n_changes", F.lit(0)).alias("n_changes"))


@query(f"SELECT DISTINCT law_id, mst FROM ({_FEED}) f WHERE law_id IN (SELECT law_id FROM laws) AND NOT EXISTS (SELECT 1 FROM law_articles a WHERE a.law_id = f.law_id AND a.version_mst = f.mst)")
def anti_known(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "law_articles").select("law_id", F.col("version_mst").alias("mst"))
    targets = feed(spark, d).join(table(spark, d, "laws").select("law_id").distinct(), "law_id", "left_semi")
    return targets.select("law_id", "mst").distinct().join(known, ["law_id", "mst"], "left_anti")


@query(
    """WITH s AS (SELECT law_id, min(law_name) AS law_name, min(hierarchy) AS hierarchy, min(ministry) AS ministry FROM laws GROUP BY law_id),
    i AS (SELECT law_id, max(title) AS law_name, 'new' AS hierarchy, NULL::VARCHAR AS ministry FROM law_articles GROUP BY law_id)
    SELECT coalesce(i.law_id, s.law_id) AS law_id, CASE WHEN i.law_id IS NULL THEN s.law_name ELSE i.law_name END AS law_name, coalesce(s.hierarchy, i.hierarchy) AS hierarchy, CASE WHEN i.law_id IS NULL THEN s.ministry END AS ministry
    FROM s FULL JOIN i ON s.law_id = i.law_id"""
)
def upsert_master(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "laws").groupBy("law_id").agg(*[F.min(c).alias(c) for c in ("law_name", "hierarchy", "ministry")])
    incoming = table(spark, d, "law_articles").groupBy("law_id").agg(F.max("title").alias("law_name")).withColumn("hierarchy", F.lit("new")).withColumn("ministry", F.lit(None).cast("string"))
    return ledger.upsert_master(stored, incoming, "law_id", kept=["hierarchy"])


@query(f"SELECT DISTINCT law_id, version_mst AS mst FROM law_articles UNION SELECT law_id, mst FROM ({_FEED})")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "law_articles").select("law_id", F.col("version_mst").alias("mst")).distinct()
    return ledger.insert_absent(stored, feed(spark, d).select("law_id", "mst"), ["law_id", "mst"])


# --- scalars over whole tables


@query("SELECT content_hash, count(*) AS n_docs FROM (SELECT sha256(text) AS content_hash FROM documents) GROUP BY ALL HAVING count(*) > 1")
def content_hash_repeats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(text.content_hash("text").alias("content_hash")).agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")


_SPACE = "a3f0b6de6d0e5b5c9f550c1c1f3f7f10"


@query(
    f"""WITH h AS (SELECT DISTINCT id, sha1(unhex('{_SPACE}') || encode(law_id || ':' || article_no || ':' || coalesce(paragraph_no, 0) || ':' || version_mst)) AS h FROM law_articles)
    SELECT id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (position(substring(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point FROM h"""
)
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "law_articles").select("id", *KEY, "version_mst").distinct()
    return rows.select("id", text.point_id(F.col("law_id"), F.col("article_no"), F.col("paragraph_no"), F.col("version_mst")).alias("point"))


@query("SELECT DISTINCT article_no, '제' || (article_no // 100) || '조' || CASE WHEN article_no % 100 > 0 THEN '의' || (article_no % 100) ELSE '' END AS label FROM law_articles")
def article_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_articles").select("article_no").distinct().select("article_no", text.code_label("article_no").alias("label"))


@query(f"SELECT DISTINCT hs, rpad(coalesce({DIGITS.format(c='hs')}, ''), 10, '0') AS code10 FROM ccct_progress")
def normalize_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ccct_progress").select("hs", text.normalize_code("hs").alias("code10")).distinct()


@query(rf"SELECT DISTINCT id, CASE WHEN length(h) > 72 THEN substring(h, 1, 71) || '…' ELSE h END AS head FROM (SELECT id, {TRIM.format(c='string_split(content, chr(10))[1]')} AS h FROM law_articles)")
def first_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_articles").select("id", text.shortened(text.first_line("content")).alias("head")).distinct()


# --- chunks of raw bodies


@query(body_sql.META_SQL)
def body_meta(spark: SparkSession, d: str) -> DataFrame:
    return chunking.body_meta(table(spark, d, "law_bodies_raw").dropDuplicates(["body_id", "body"]))


@query(body_sql.CHUNKS_SQL)
def article_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.article_chunks(table(spark, d, "law_bodies_raw"))


@query(f"SELECT DISTINCT id FROM ({LIVE}) a WHERE is_current AND NOT EXISTS (SELECT 1 FROM ({LIVE}) c WHERE c.parent_article_pk = a.id)")
def indexable(spark: SparkSession, d: str) -> DataFrame:
    return chunking.indexable(views.slim_ledger(spark, d, "is_current", "parent_article_pk", "qdrant_point_id")).select("id").distinct()


# --- retrieval


@query(f"WITH tok AS (SELECT doc_id, {TOKENS.format(c='text')} AS toks FROM documents) SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct FROM tok")
def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", lexical.tokens(F.col("text")).alias("toks"))
    return rows.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_distinct"))


@query(f"WITH {POSTED} SELECT doc_id, round(sum({WEIGHT}), 6) AS weight FROM posted GROUP BY doc_id")
def bm25_tf_weights(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.round(F.sum("weight"), 6).alias("weight"))


_TOKEN_ID = "('0x' || substring(md5(token), 7, 2) || substring(md5(token), 5, 2) || substring(md5(token), 3, 2) || substring(md5(token), 1, 2))::BIGINT"


@query(f"WITH {POSTED} SELECT {_TOKEN_ID} AS token_id, count(DISTINCT doc_id) AS df, round(ln(((SELECT count(*) FROM documents) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5) + 1), 6) AS idf FROM posted GROUP BY ALL")
def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    df = search.token_frequencies(docs, "text")
    return df.select("token_id", "df", F.round(lexical.idf(docs.agg(F.count(F.lit(1))).scalar(), F.col("df")), 6).alias("idf"))


_BM25 = f"""{POSTED}, q AS (SELECT DISTINCT unnest({TOKENS.format(c=f"'{QUERY}'")}) AS token),
hits AS (SELECT posted.* FROM posted JOIN q USING (token)), dfs AS (SELECT token, count(*) AS df FROM hits GROUP BY token),
bm AS (SELECT doc_id, sum({WEIGHT} * ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1)) AS score FROM hits JOIN dfs USING (token) GROUP BY doc_id ORDER BY round(score, 9) DESC, doc_id LIMIT 20)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_scan(table(spark, d, "documents"), "doc_id", "text", QUERY, 20).select("doc_id", F.round("score", 6).alias("score"))


_DENSE = "dn AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 20)"


def dense_hits(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id = 0 and embedding is not null").first()
    return search.dense_search(vectors, "vec_id", "embedding", list(asked["embedding"]) if asked else [], 20)


@query(f"WITH {_DENSE} SELECT doc_id, round(score, 6) AS score FROM dn")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense_hits(spark, d).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25}, {_DENSE} SELECT doc_id, round(score, 4) AS score, 'bm25' AS arm FROM bm UNION ALL SELECT doc_id, round(score, 4), 'dense' FROM dn")
def two_arms(spark: SparkSession, d: str) -> DataFrame:
    both = search.two_arms(dense_hits(spark, d), search.bm25_scan(table(spark, d, "documents"), "doc_id", "text", QUERY, 20))
    return both.select("doc_id", F.round("score", 4).alias("score"), "arm")


# Every row whose id is divisible by 100 is a query, against all rows.
_DENSE_ALL = """dn AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20)"""
_BM25_ALL = f"""{POSTED}, q AS (SELECT DISTINCT doc_id AS query_id, token FROM posted WHERE doc_id % 100 = 0), dfs AS (SELECT token, count(*) AS df FROM posted GROUP BY token),
hits AS (SELECT query_id, doc_id, sum({WEIGHT} * ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1)) AS score FROM posted JOIN q USING (token) JOIN dfs USING (token) GROUP BY query_id, doc_id),
bm AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20)"""


def dense_hits_all(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return search.dense_search_all(vectors, "vec_id", "embedding", vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20)


def bm25_hits_all(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return search.bm25_search_all(docs, "doc_id", "text", docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"), 20)


@query(f"WITH {_DENSE_ALL} SELECT query_id, doc_id, round(score, 6) AS score FROM dn")
def dense_topk_all(spark: SparkSession, d: str) -> DataFrame:
    return dense_hits_all(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25_ALL} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_topk_all(spark: SparkSession, d: str) -> DataFrame:
    return bm25_hits_all(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25_ALL}, {_DENSE_ALL} SELECT query_id, doc_id, round(score, 4) AS score, 'bm25' AS arm FROM bm UNION ALL SELECT query_id, doc_id, round(score, 4), 'dense' FROM dn")
def two_arms_all(spark: SparkSession, d: str) -> DataFrame:
    return search.two_arms(dense_hits_all(spark, d), bm25_hits_all(spark, d)).select("query_id", "doc_id", F.round("score", 4).alias("score"), "arm")


_ONE = f"one AS (SELECT * FROM ({LIVE}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
_CUR = f"""{_ONE}, cur AS (SELECT * FROM one WHERE is_current), tok AS (SELECT id AS doc_id, {TOKENS.format(c="content")} AS toks FROM cur),
q AS (SELECT DISTINCT unnest({TOKENS.format(c=f"'{QUERY}'")}) AS token),
hits AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS token FROM tok) WHERE token IN (SELECT token FROM q) GROUP BY ALL), dfs AS (SELECT token, count(*) AS df FROM hits GROUP BY token),
bm AS (SELECT doc_id, sum({WEIGHT} * ln(((SELECT count(*) FROM cur) - df + 0.5) / (df + 0.5) + 1)) AS score FROM hits JOIN dfs USING (token) GROUP BY doc_id ORDER BY round(score, 9) DESC, doc_id LIMIT {{n}})"""


def _search(spark: SparkSession, d: str, arm: str, as_of: Column | None = None) -> DataFrame:
    """The vectors' table stands for stored vectors of the articles of its ids; the dense query is the vector of id 0."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id = 0 and embedding is not null").first() if arm == "dense" else None
    stored = vectors.select(F.col("vec_id").alias("id"), "embedding")
    versions = written(views.versions(spark, d, *search.LEDGER), "versions")
    return search.search(versions, QUERY, arm, 10, as_of, stored, list(asked["embedding"]) if asked else [], views.texts(spark, d))


@query(f"WITH {_CUR.format(n=10)} SELECT doc_id AS article_pk, round(score, 6) AS score, content AS text FROM bm JOIN cur ON cur.id = doc_id")
def search_current(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "bm25").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_CUR.format(n=30)}, r AS (SELECT bm.*, law_id, article_no, paragraph_no FROM bm JOIN cur ON cur.id = doc_id)
    SELECT o.id AS article_pk, round(score, 6) AS score, o.content AS text FROM r JOIN one o ON o.law_id = r.law_id AND o.article_no = r.article_no AND o.paragraph_no IS NOT DISTINCT FROM r.paragraph_no
    WHERE o.valid_from <= DATE '{AS_OF}' AND (o.valid_to IS NULL OR o.valid_to > DATE '{AS_OF}') ORDER BY round(score, 9) DESC, doc_id, o.id LIMIT 10"""
)
def search_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "bm25", day()).withColumn("score", F.round("score", 6))


_DCUR = f"""{_ONE}, cur AS (SELECT * FROM one WHERE is_current),
bm AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e JOIN cur ON cur.id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round(score, 9) DESC, doc_id LIMIT {{n}})"""


@query(f"WITH {_DCUR.format(n=10)} SELECT doc_id AS article_pk, round(score, 6) AS score, content AS text FROM bm JOIN cur ON cur.id = doc_id")
def search_dense(spark: SparkSession, d: str) -> DataFrame:
    """The dense arm over current versions and stored vectors."""
    return _search(spark, d, "dense").withColumn("score", F.round("score", 6))


_THEN = f"""SELECT o.id AS article_pk, round(score, 6) AS score, o.content AS text, r.doc_id FROM (SELECT bm.*, law_id, article_no, paragraph_no FROM bm JOIN cur ON cur.id = doc_id) r
    JOIN one o ON o.law_id = r.law_id AND o.article_no = r.article_no AND o.paragraph_no IS NOT DISTINCT FROM r.paragraph_no
    WHERE o.valid_from <= DATE '{AS_OF}' AND (o.valid_to IS NULL OR o.valid_to > DATE '{AS_OF}') ORDER BY round(score, 9) DESC, r.doc_id, o.id LIMIT 10"""


@query(f"WITH {_DCUR.format(n=30)} SELECT article_pk, score, text FROM ({_THEN})")
def search_dense_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "dense", day()).withColumn("score", F.round("score", 6))


@query(f"WITH {_CUR.format(n=10)} SELECT doc_id AS article_pk, round(score, 4) AS score, {TRIM.format(c='string_split(content, chr(10))[1]')} AS head FROM bm JOIN cur ON cur.id = doc_id ORDER BY round(bm.score, 9) DESC, doc_id LIMIT 5")
def api_hits(spark: SparkSession, d: str) -> DataFrame:
    """What a service shows of a search: five hits, rounded scores, first lines."""
    return search.api_hits(_search(spark, d, "bm25"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """The keyword arm over postings written once, of which only the query's folders are read."""
    docs, root = table(spark, d, "documents"), scratch_path(spark, "postings")
    search.write_postings(search.postings(docs, "doc_id", "text"), root)
    return search.bm25_stored(spark, root, docs.agg(F.count(F.lit(1))), QUERY, 20).select("doc_id", F.round("score", 6).alias("score"))


# --- citations


@query(f"WITH {FAMILY} SELECT law_id, base, rank, act_id, decree_id, rule_id FROM fam")
def law_families(spark: SparkSession, d: str) -> DataFrame:
    return refgraph.law_families(table(spark, d, "laws")).select("law_id", "base", "rank", "act_id", "decree_id", "rule_id")


@query(f"WITH {CITED} SELECT * FROM refs")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return views.citation_graph(spark, d)[1]


@query(f"WITH {CITED} SELECT * FROM gedges")
def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return views.citation_graph(spark, d)[2]


@query(
    f"WITH {CITED}, ln AS (SELECT law_id, min(law_name) AS law_name FROM laws GROUP BY law_id) SELECT src AS article_pk, rel, dst, law_name, article_no, coalesce(title, law_name) AS title, basis, n FROM gedges JOIN art ON art.id = dst JOIN ln USING (law_id) WHERE src IN (SELECT id FROM art WHERE law_id = '900001')"
)
def expand_one_hop(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, edges = views.citation_graph(spark, d)
    return refgraph.expand(nodes.where("law_id = '900001'"), edges, nodes)


_HOPS = "SELECT src AS article_pk, rel, dst, law_name, article_no, coalesce(title, law_name) AS title, basis, n FROM gedges JOIN art ON art.id = dst JOIN ln USING (law_id)"


@query(f"WITH {CITED}, ln AS (SELECT law_id, min(law_name) AS law_name FROM laws GROUP BY law_id) {_HOPS}")
def expand_one_hop_all(spark: SparkSession, d: str) -> DataFrame:
    """One hop from every article, of whatever law."""
    nodes, _, edges = views.citation_graph(spark, d)
    return refgraph.expand(nodes, edges, nodes)


# --- catalogue and requirements


@query(f"WITH {NODES} SELECT length(code) AS level, count(*) AS n_nodes FROM now GROUP BY ALL")
def catalog_levels(spark: SparkSession, d: str) -> DataFrame:
    return catalog.level_counts(views.catalogue(spark, d))


@query(
    f"""WITH {NODES} SELECT n.code, substring(n.code, 1, 6) AS hs6, a.name_ko AS hs6_name, b.name_ko AS heading4_name, c.name_ko AS chapter2_name FROM now n
    LEFT JOIN now a ON a.code = substring(n.code, 1, 6) LEFT JOIN now b ON b.code = substring(n.code, 1, 4) LEFT JOIN now c ON c.code = substring(n.code, 1, 2) WHERE length(n.code) = 10"""
)
def catalog_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_ancestors(views.catalogue(spark, d)).select("code", "hs6", "hs6_name", "heading4_name", "chapter2_name")


@query(
    f"""WITH {NODES}, days AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS no FROM (SELECT DISTINCT snapshot_date FROM hs_node_snapshots WHERE snapshot_date IS NOT NULL)),
    n AS (SELECT nodes.*, no FROM nodes JOIN days USING (snapshot_date)),
    met AS (SELECT coalesce(b.no, a.no + 1) AS no, coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NULL THEN 'added' WHEN b.code IS NULL THEN 'removed' WHEN a.name_ko IS DISTINCT FROM b.name_ko THEN 'renamed' END AS change, a.name_ko AS old_name, b.name_ko AS new_name
      FROM n a FULL JOIN n b ON a.code = b.code AND b.no = a.no + 1)
    SELECT snapshot_date AS day, code, change, old_name, new_name FROM met JOIN days USING (no) WHERE no > 1 AND change IS NOT NULL"""
)
def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    """Differences of each snapshot of the catalogue to the one before."""
    nodes = table(spark, d, "hs_node_snapshots")
    rows = snapdiff.latest_rows(nodes, text.digits_of("code"), "snapshot_date", F.struct("row_id", "name_ko"), F.col("loaded_at"), [F.col("row_id")])
    return catalog.snapshot_diffs(rows.select(F.col("key").alias("code"), "day", F.col("value.name_ko").alias("name_ko")), nodes.select(F.col("snapshot_date").alias("day")))


@query(
    f"""WITH {NODES}, attr AS (SELECT {DIGITS.format(c="code")} AS code, max(quantity_unit) AS quantity_unit, max(category_name) AS category_name FROM hs_node_snapshots WHERE is_leaf AND category_code IS NOT NULL GROUP BY 1)
    SELECT n.code, quantity_unit, category_name, CASE WHEN length(n.code) = 10 THEN attr.code IS NOT NULL END AS has_attributes FROM now n LEFT JOIN attr ON attr.code = n.code"""
)
def leaf_attributes(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "hs_node_snapshots").where(F.col("is_leaf") & F.col("category_code").isNotNull())
    per = raw.groupBy(text.digits_of("code").alias("code")).agg(F.max("quantity_unit").alias("quantity_unit"), F.max("category_name").alias("category_name"))
    return catalog.leaf_attributes(views.catalogue(spark, d).select("code"), per.where(F.col("code").isNotNull())).select("code", "quantity_unit", "category_name", "has_attributes")


@query(f"WITH {NODES} SELECT code, name_ko, name_en, length(code) AS level, length(code) = 10 AS is_leaf FROM now")
def union_sheets(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.catalogue(spark, d).select("code", "name_ko", "name_en")
    return catalog.union_sheets([nodes.where(F.length("code") == n) for n in catalog.LEVELS])


@query(f"WITH {NODES}, {ITEMS} SELECT * FROM edges")
def requirement_load(spark: SparkSession, d: str) -> DataFrame:
    return requirements.requires_edges(views.sweep(spark, d))


@query(f"WITH {NODES}, {ITEMS} SELECT * FROM paths")
def requirement_traverse(spark: SparkSession, d: str) -> DataFrame:
    return views.requirement_paths(spark, d)


@query(
    f"""WITH {NODES}, {ITEMS}, asked AS (SELECT code AS hsk10, unnest(list_distinct([code, substring(code, 1, 6), substring(code, 1, 4), substring(code, 1, 2)])) AS hs FROM now WHERE is_leaf)
    SELECT hsk10, hs AS on_code, CASE WHEN hs = hsk10 THEN 'direct' ELSE 'inherited' END AS source, length(hs) AS level, law_code, trade_type, valid_from, document, rtm_tpcd, law_name, agencies
    FROM asked JOIN paths USING (hs) WHERE valid_from = '' OR valid_from <= '20200101'"""
)
def requirement_lookup(spark: SparkSession, d: str) -> DataFrame:
    leaves = views.catalogue(spark, d).where("is_leaf").select("code")
    return requirements.lookup(leaves, views.requirement_paths(spark, d), as_of="20200101")


_ASKED = "asked AS (SELECT code AS hsk10, unnest(list_distinct([code, substring(code, 1, 6), substring(code, 1, 4), substring(code, 1, 2)])) AS hs FROM now WHERE is_leaf)"


def _requirement_lines(traded: str = "true") -> str:
    return f"""WITH {NODES}, {ITEMS}, {_ASKED},
    req AS (SELECT hsk10, list_sort(list(concat_ws('|', trade_type, law_code, law_name, document, array_to_string(agencies, ','), valid_from, CASE WHEN hs = hsk10 THEN 'direct' ELSE 'inherited' END, length(hs)))) AS lines FROM asked JOIN paths USING (hs) WHERE {traded} GROUP BY hsk10)
    SELECT l.code AS hsk10, l.name_ko, l.name_en, r.lines IS NOT NULL AS subject, concat_ws(' › ', c.name_ko, b.name_ko, a.name_ko) AS chain, coalesce(r.lines, []) AS lines
    FROM now l LEFT JOIN now a ON a.code = substring(l.code, 1, 6) LEFT JOIN now b ON b.code = substring(l.code, 1, 4) LEFT JOIN now c ON c.code = substring(l.code, 1, 2) LEFT JOIN req r ON r.hsk10 = l.code WHERE l.is_leaf"""


def _responses(spark: SparkSession, d: str, trade_type: str | None = None) -> DataFrame:
    nodes = views.catalogue(spark, d)
    leaves = nodes.where("is_leaf").select("code")
    return requirements.response_lines(requirements.lookup_response(leaves, nodes, requirements.lookup(leaves, views.requirement_paths(spark, d), trade_type)))


@query(_requirement_lines())
def requirement_responses(spark: SparkSession, d: str) -> DataFrame:
    """The nested answer of every product, as lines."""
    return _responses(spark, d)


@query(_requirement_lines("trade_type = '수입'"))
def requirement_imports(spark: SparkSession, d: str) -> DataFrame:
    """The same for one direction."""
    return _responses(spark, d, "수입")


@query(f"WITH {NODES} SELECT code AS hs, t AS tpcd FROM now, (VALUES ('1'), ('2')) v(t) WHERE is_leaf AND NOT EXISTS (SELECT 1 FROM ccct_progress p WHERE {DIGITS.format(c='p.hs')} = code AND trim(p.tpcd) = t)")
def sweep_todo(spark: SparkSession, d: str) -> DataFrame:
    return requirements.sweep_todo(views.catalogue(spark, d).where("is_leaf"), table(spark, d, "ccct_progress"))


@query(f"WITH {NODES}, {ITEMS} SELECT law_code, count(DISTINCT hs) AS n_products, count(DISTINCT agency_code) AS n_agencies, list_sort(list(DISTINCT document))[1:2] AS sample FROM known GROUP BY law_code")
def requirement_report(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts and a slice of a collected set, per confirming law; a law's documents are names, hence few."""
    return views.sweep(spark, d).groupBy("law_code").agg(
        F.count_distinct("hs").alias("n_products"), F.count_distinct("agency_code").alias("n_agencies"), F.slice(F.sort_array(F.collect_set("document")), 1, 2).alias("sample")
    )


# --- checks


@query(f"SELECT law_id, count(*) AS n_rows, count(*) FILTER (is_current) AS n_current, count(*) FILTER (valid_to IS NULL) AS n_open, count(*) FILTER (valid_from > DATE '{AS_OF}') AS n_future FROM (SELECT DISTINCT id, law_id, is_current, valid_from, valid_to FROM ({LIVE})) GROUP BY law_id")
def law_report(spark: SparkSession, d: str) -> DataFrame:
    return checks.law_report(views.slim_ledger(spark, d, "law_id", "is_current", "valid_from", "valid_to"), day())


def _checked(*counts: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) AS n_bad FROM ({q})" for n, q in counts)


@query(
    f"""WITH {_SPANS}, r AS (SELECT * FROM ({LIVE}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)
    """
    + _checked(
        ("overlapping_rows", "SELECT 1 FROM s WHERE EXISTS (SELECT 1 FROM s e WHERE e.law_id = s.law_id AND e.article_no = s.article_no AND e.paragraph_no IS NOT DISTINCT FROM s.paragraph_no AND (e.valid_from < s.valid_from OR (e.valid_from = s.valid_from AND e.id < s.id)) AND (e.valid_to IS NULL OR e.valid_to > s.valid_from))"),
        ("is_current_stale", f"SELECT 1 FROM r WHERE is_current <> ({HOLDS.format(d=AS_OF)})"),
        ("period_not_forward", "SELECT 1 FROM r WHERE valid_to <= valid_from"),
        ("hash_length", "SELECT 1 FROM r WHERE NOT coalesce(regexp_full_match(content_hash, '[0-9a-f]{64}'), false)"),
        ("hash_differs", "SELECT 1 FROM r WHERE sha256(content) <> content_hash"),
        ("version_not_registered", f"SELECT 1 FROM r WHERE NOT EXISTS (SELECT 1 FROM ({_FEED}) f WHERE f.law_id = r.law_id AND f.mst = r.version_mst)"),
    )
)
def ledger_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = views.slim_ledger(spark, d, *KEY, "content", "content_hash", "version_mst", "valid_from", "valid_to", "is_current")
    return checks.ledger_checks(rows, day(), feed(spark, d))


@query(f"WITH {NODES} " + _checked(("code_length", "SELECT DISTINCT code FROM now WHERE length(code) NOT IN (2, 4, 5, 6, 7, 8, 9, 10)"), ("code_twice", "SELECT code FROM now GROUP BY code HAVING count(*) > 1"), ("leaf_flag", "SELECT 1 FROM now WHERE is_leaf <> (length(code) = 10)"), ("prefix_differs", "SELECT 1 FROM now WHERE length(code) = 10 AND (hs6 <> substring(code, 1, 6) OR heading4 <> substring(code, 1, 4) OR chapter2 <> substring(code, 1, 2))")))
def catalog_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.catalog_checks(views.catalogue(spark, d))


@query(f"WITH {CITED} " + _checked(("self_loop", "SELECT 1 FROM gedges WHERE src = dst"), ("cites_other_law", "SELECT 1 FROM gedges JOIN art a ON a.id = src JOIN art b ON b.id = dst WHERE rel = 'CITES' AND a.law_id <> b.law_id"), ("delegates_not_down", "SELECT 1 FROM gedges JOIN art a ON a.id = src JOIN art b ON b.id = dst JOIN fam f1 ON f1.law_id = a.law_id JOIN fam f2 ON f2.law_id = b.law_id WHERE rel = 'DELEGATES' AND f1.rank >= f2.rank")))
def graph_checks(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, edges = views.citation_graph(spark, d)
    return checks.graph_checks(edges, nodes, refgraph.law_families(table(spark, d, "laws")))


@query(
    f"WITH r AS (SELECT DISTINCT id, is_current, parent_article_pk, qdrant_point_id FROM ({LIVE})), i AS (SELECT DISTINCT id FROM r a WHERE is_current AND NOT EXISTS (SELECT 1 FROM r c WHERE c.parent_article_pk = a.id)) "
    + _checked(("point_missing", "SELECT id FROM i WHERE id NOT IN (SELECT id FROM r WHERE qdrant_point_id IS NOT NULL)"), ("point_spare", "SELECT DISTINCT id FROM r WHERE qdrant_point_id IS NOT NULL AND id NOT IN (SELECT id FROM i)"), ("point_twice", "SELECT qdrant_point_id FROM r WHERE qdrant_point_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) > 1"))
)
def index_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = views.slim_ledger(spark, d, "is_current", "parent_article_pk", "qdrant_point_id")
    return checks.index_checks(rows, chunking.indexable(rows), "qdrant_point_id")


@query(f"WITH {NODES}, {ITEMS} " + _checked(("edge_level", "SELECT 1 FROM edges WHERE length(hs) NOT IN (2, 4, 6, 10)"), ("law_without_agency", "SELECT DISTINCT law_code FROM edges WHERE law_code NOT IN (SELECT law_code FROM known)"), ("edge_shape", "SELECT 1 FROM edges WHERE NOT (trade_type IN ('수출', '수입') AND (valid_from = '' OR regexp_full_match(valid_from, '[0-9]{8}')))")))
def requirement_checks(spark: SparkSession, d: str) -> DataFrame:
    items = views.sweep(spark, d)
    return checks.requirement_checks(requirements.requires_edges(items), requirements.approvals(items))


@query("SELECT count(*) AS n_bad FROM ((SELECT DISTINCT law_id FROM laws EXCEPT SELECT law_id FROM law_articles) UNION ALL (SELECT DISTINCT law_id FROM law_articles EXCEPT SELECT law_id FROM laws))")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    return checks.both_ways("laws", table(spark, d, "laws"), table(spark, d, "law_articles"), ["law_id"]).select("n_bad")


@query(
    f"""WITH live AS (SELECT *, coalesce(paragraph_no, 0) AS para FROM ({LIVE}) WHERE valid_from IS NOT NULL), one AS (SELECT *, min(loaded_at) OVER (PARTITION BY id) AS f FROM live),
    b AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY law_id, article_no, para, valid_from ORDER BY f DESC, id DESC) = 1),
    l AS (SELECT content_hash IS DISTINCT FROM lag(content_hash) OVER w AS c, version_mst IS DISTINCT FROM lag(version_mst) OVER w AS v, title IS DISTINCT FROM lag(title) OVER w AS t, lag(1) OVER w AS p FROM b WINDOW w AS (PARTITION BY law_id, article_no, para ORDER BY valid_from))
    SELECT unnest(['content_hash', 'title', 'version_mst']) AS attribute, unnest([round(count(*) FILTER (c AND p = 1) / greatest(count(p), 1), 6), round(count(*) FILTER (t AND p = 1) / greatest(count(p), 1), 6), round(count(*) FILTER (v AND p = 1) / greatest(count(p), 1), 6)]) AS rate FROM l"""
)
def change_rates(spark: SparkSession, d: str) -> DataFrame:
    from lexstrata.plans.problems import ARTICLE_KEY, live_versions

    rates = history.change_rates(live_versions(spark, d), ARTICLE_KEY, "valid_from", ["content_hash", "title", "version_mst"])
    return rates.select("attribute", F.round("rate", 6).alias("rate"))


def all_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every check in one report."""
    return reduce(DataFrame.unionByName, [f(spark, d) for f in (ledger_checks, catalog_checks, graph_checks, index_checks, requirement_checks)])
