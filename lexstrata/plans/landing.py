"""Queries that land the tables as the files a fetcher would leave, read them back, and hand results on; scalar functions on known cases; and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions import text
from lexstrata.operators import catalog, chunking
from lexstrata.plans import body_sql, views
from lexstrata.plans.reference import DIGITS, NODES, query
from lexstrata.session import scratch_path, table
from lexstrata.sources import files, sinks


def _one_file_each(rows: DataFrame, key: str, root: str) -> None:
    """(key, text): a folder of one file a key."""
    rows.repartition(key).write.partitionBy(key).text(root)


@query("SELECT DISTINCT body_id, sha256(body) AS body_hash FROM law_bodies_raw")
def landed_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Law bodies as landed files through the cache: read from the landing folder once, then from the cache."""
    root, cache = scratch_path(spark, "bodies"), scratch_path(spark, "cache")
    _one_file_each(table(spark, d, "law_bodies_raw").select("body_id", "body").distinct(), "body_id", root)
    for use in (True, True, False):
        got = files.read_through(spark, cache, lambda: files.law_bodies(spark, f"{root}/*/*"), use)
    return got.select(F.regexp_extract("path", "body_id=([0-9]+)", 1).cast("long").alias("body_id"), F.sha2(F.regexp_replace("body", "\n$", ""), 256).alias("body_hash"))


_PAGE = dict(zip(("법령ID", "법령일련번호", "시행일자", "공포일자", "제개정구분명"), ("law_id", "mst", "enforcement_date", "promulgation_date", "revision_type")))


@query(f"SELECT {', '.join(_PAGE.values())}, count(*) AS n FROM ls_hst_inf GROUP BY ALL")
def landed_pages(spark: SparkSession, d: str) -> DataFrame:
    """The change feed as landed JSON pages, a month each."""
    root = scratch_path(spark, "pages")
    rows = table(spark, d, "ls_hst_inf").select(F.substring("reg_dt", 1, 6).alias("month"), F.struct(*[F.col(c).alias(n) for n, c in _PAGE.items()]).alias("law"))
    pages = rows.groupBy("month").agg(F.collect_list("law").alias("law"))  # a page of a service is a bounded list
    _one_file_each(pages.select("month", F.to_json(F.struct(F.struct("law").alias("LawSearch"))).alias("page")), "month", root)
    got = files.change_pages(spark, f"{root}/*/*").withColumnsRenamed(_PAGE)
    return got.groupBy(*_PAGE.values()).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT rec_no, CASE WHEN items IS NULL THEN 'quota' ELSE 'ok' END AS status, coalesce(len(items), 0)::INT AS n_items, coalesce(items[1].dcerCfrmLworNm, '') AS first_law FROM ccct_progress")
def requirement_answers(spark: SparkSession, d: str) -> DataFrame:
    """Sweep answers as the service's XML, read; for records without items its answer that the quota is used up."""
    rows = table(spark, d, "ccct_progress").select("rec_no", "items").distinct()
    answer = F.struct(F.struct(F.lit("00").alias("resultCode")).alias("header"), F.struct(F.struct(F.col("items").alias("item")).alias("items")).alias("body"))
    quota = F.lit("<OpenAPI_ServiceResponse><cmmMsgHeader><returnReasonCode>22</returnReasonCode><returnAuthMsg>LIMITED</returnAuthMsg></cmmMsgHeader></OpenAPI_ServiceResponse>")
    xml = F.when(F.col("items").isNull(), quota).otherwise(F.to_xml(answer, {"rowTag": "response"}))
    got = files.requirement_answer(rows.select("rec_no", xml.alias("xml")), "xml")
    first = F.coalesce(F.try_element_at("answer.items", F.lit(1))["dcerCfrmLworNm"], F.lit(""))
    return got.select("rec_no", "answer.status", F.size("answer.items").alias("n_items"), first.alias("first_law"))


@query("SELECT hs, tpcd, count(*) AS n_records, sum(coalesce(len(items), 0))::BIGINT AS n_items FROM ccct_progress WHERE hs IS NOT NULL GROUP BY ALL")
def landed_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The sweep log as appended JSON lines, one of them torn."""
    root = scratch_path(spark, "sweep")
    sinks.append_json(table(spark, d, "ccct_progress").select("hs", "tpcd", "items"), root)
    spark.createDataFrame([('{"hs": "0101", "tp',)], "line string").write.mode("append").text(root)
    return files.sweep_log(spark, root).groupBy("hs", "tpcd").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.coalesce(F.size("items"), F.lit(0))).cast("long").alias("n_items"))


def _csv(df: DataFrame, root: str) -> str:
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    return root


@query(f"WITH {NODES} SELECT code, name_ko, name_en, length(code) AS level, length(code) = 10 AS is_leaf FROM now")
def landed_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue as one CSV sheet a level, concatenated."""
    nodes = views.catalogue(spark, d).select("code", "name_ko", "name_en")
    paths = [_csv(nodes.where(F.length("code") == n), scratch_path(spark, f"sheet{n}")) for n in catalog.LEVELS]
    return catalog.union_sheets([s if s.columns else spark.createDataFrame([], "code string, name_ko string, name_en string") for s in files.sheets(spark, paths)])


_LEAF = ("valid_from", "valid_to", "quantity_unit", "weight_unit", "category_code", "category_name")


@query(
    f"""WITH l AS (SELECT *, {DIGITS.format(c="code")} AS c FROM hs_node_snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM hs_node_snapshots) AND {DIGITS.format(c="code")} IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY {DIGITS.format(c="code")} ORDER BY loaded_at DESC, row_id DESC) = 1)
    SELECT c AS code, {", ".join(_LEAF)} FROM l WHERE length(c) = 10"""
)
def leaf_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The leaves' sheet with the source's headers and dates, read back: leaves only, dates as ISO strings, real nulls."""
    nodes = table(spark, d, "hs_node_snapshots")
    rows = nodes.where(F.col("snapshot_date") == nodes.agg(F.max("snapshot_date")).scalar()).withColumn("code", text.digits_of("code")).where("code is not null")
    last = rows.groupBy("code").agg(F.max_by(F.struct(*_LEAF), F.struct("loaded_at", "row_id")).alias("r")).select("code", "r.*")
    digits = {c: F.regexp_replace(c, "-", "") for c in _LEAF[:2]}
    sheet = last.withColumns(digits).select(*[F.col(n).alias(h) for h, n in files.LEAF_HEADERS.items()])
    return files.leaf_sheet(spark, _csv(sheet, scratch_path(spark, "leaves"))).select("code", *_LEAF)


@query(
    r"""WITH n AS (SELECT DISTINCT regexp_replace(law_name, '[\s\pZ]+', '', 'g') AS name FROM laws WHERE law_name IS NOT NULL UNION SELECT '없는법')
    SELECT name, (SELECT min(law_id) FROM laws WHERE regexp_replace(law_name, '[\s\pZ]+', '', 'g') = name) AS law_id FROM n"""
)
def law_names(spark: SparkSession, d: str) -> DataFrame:
    """Every law found by its name without blanks, and one that there isn't."""
    laws = table(spark, d, "laws")
    names = laws.where(F.col("law_name").isNotNull()).select(text.squash("law_name").alias("name")).unionByName(spark.createDataFrame([("없는법",)], "name string"))
    return files.find_laws(laws, names)


@query("SELECT max(strptime(reg_dt, '%Y%m%d')::DATE) AS last_synced_on FROM ls_hst_inf HAVING count(*) > 0")
def watermark(spark: SparkSession, d: str) -> DataFrame:
    """The day up to which changes are known, written as the watermark over an older one, and read."""
    root = scratch_path(spark, "watermark")
    last = table(spark, d, "ls_hst_inf").agg(F.max(text.strict_date("reg_dt"))).first()[0]
    for day in (dt.date(2000, 1, 1), last):
        if day:
            sinks.write_watermark(spark, root, day)
    sinks.write_watermark(spark, root, dt.date(2100, 1, 1), dry_run=True)
    return sinks.read_published(spark, root)


@query(f"SELECT concat_ws('-', law_id, article_no // 100, article_no % 100) AS id, content_hash AS text_hash, paragraph_no, strftime(valid_from, '%Y-%m-%d') AS enforcement_date FROM ({body_sql.CHUNKS_SQL})")
def chunk_handover(spark: SparkSession, d: str) -> DataFrame:
    """Chunks handed over as JSON lines of id, text and metadata, read back."""
    root = scratch_path(spark, "chunks")
    records = sinks.chunk_records(chunking.article_chunks(table(spark, d, "law_bodies_raw")))
    sinks.append_json(records, root)
    back = spark.read.schema(records.schema).json(root)
    return back.select("id", F.sha2("text", 256).alias("text_hash"), "metadata.paragraph_no", "metadata.enforcement_date")


def _level(n: int) -> str:
    """Members of the objects of level n - 1, of lists those of the first element."""
    first = "CASE WHEN json_type({v}) = 'ARRAY' THEN json_extract({v}, '$[0]') ELSE {v} END"
    v = first.format(v=first.format(v="value"))
    return rf"l{n} AS (SELECT place || '/' || regexp_replace(je.key, '(\\[nrtf]|[ \t\n\r\f])+', '', 'g') AS place, je.value AS value FROM (SELECT place, {v} AS v FROM l{n - 1}) s, json_each(s.v) je WHERE json_type(s.v) = 'OBJECT')"


_KIND = "CASE json_type(value) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' WHEN 'NULL' THEN 'NoneType' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END"
_SIZE = "CASE json_type(value) WHEN 'OBJECT' THEN len(json_keys(value)) WHEN 'ARRAY' THEN json_array_length(value) END::INT"


@query(
    f"""WITH l0 AS (SELECT '' AS place, body::JSON AS value FROM (SELECT DISTINCT body_id, body FROM law_bodies_raw WHERE json_valid(body))), {", ".join(_level(n) for n in range(1, 5))},
    w AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4)
    SELECT place, {_KIND} AS kind, count(*) AS n, min({_SIZE}) AS least, max({_SIZE}) AS most FROM w GROUP BY ALL"""
)
def body_structure(spark: SparkSession, d: str) -> DataFrame:
    """What the bodies hold at each place of the first levels."""
    return files.structure_walk(table(spark, d, "law_bodies_raw").select("body_id", "body").distinct(), "body")


# --- scalar functions on known cases: (name, arguments, result as worked out by hand)

CASES = (
    ("squash", " 관 세 법　", "", "관세법"), ("squash", None, "", ""), ("clean_text", "a&nbsp;&lt;b&gt; \t\n c ", "", "a <b>\n c"), ("clean_text", None, "", ""), ("clean_text", "　x ", "", "x"),
    ("article_code", "226", "", "22600"), ("article_code", "5", "2", "502"), ("article_code", "０7", "", "700"), ("article_code", "x", "", None), ("article_label", "0005", "02", "제5조의2"), ("article_label", "7", "00", "제7조"), ("article_label", "7", "000", "제7조의0"),
    ("parse_article", "226", "", "22600"), ("parse_article", "5의2", "", "502"), ("parse_article", "5의", "", None), ("hierarchy", "무역법 시행령", "", "시행령"), ("hierarchy", "무역법 시행규칙", "", "시행규칙"), ("hierarchy", "무역법", "", "법률"),
    ("short_name", "법", "", "act"), ("short_name", "시행령", "", "decree"), ("short_name", "규칙", "", "rule"), ("short_name", "조례", "", None), ("strict_date", "20240229", "", "2024-02-29"), ("lenient_date", "20230229", "", None), ("lenient_date", "20240229", "", "2024-02-29"), ("lenient_date", "", "", None),
    ("iso_date", "2024-02-29", "", "2024-02-29"), ("iso_date", "2024-2-30", "", None), ("normalize_code", "０１01 21", "", "0101210000"), ("normalize_code", "123456789012", "", "1234567890"), ("normalize_code", None, "", "0000000000"), ("first_line", "  a b  c", "", "a b"), ("first_line", "a\rb", "", "a"),
    ("shortened", "가" * 80, "", "가" * 71 + "…"), ("heading", "무역법", "목적", "[무역법 제1조(목적)]"), ("heading", "무역법", "", "[무역법 제1조]"), ("content_hash", "", "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("lookup_day", "2024-03-01", "", "20240301"), ("code_label", "502", "", "제5조의2"), ("code_label", "22600", "", "제226조"),
)


def _sql(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}', {_sql(want)})" for i, (name, _, _, want) in enumerate(CASES)) + ") v(no, name, result)")
def scalar_cases(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions on cases whose results are known."""
    rows = spark.createDataFrame([(i, n, a, b) for i, (n, a, b, _) in enumerate(CASES)], "no int, name string, a string, b string")
    a, b = F.col("a"), F.col("b")
    short = F.create_map(*[F.lit(x) for pair in text.SHORT_NAMES.items() for x in pair])
    made = {
        "squash": text.squash(a), "clean_text": text.clean_text(a), "article_code": text.article_code(a, b).cast("string"), "article_label": text.article_label(a, b), "parse_article": text.parse_article(a).cast("string"),
        "hierarchy": text.hierarchy_of(a), "short_name": F.try_element_at(short, a), "strict_date": text.strict_date(F.when(F.col("name") == "strict_date", a)).cast("string"), "lenient_date": text.lenient_date(a).cast("string"),
        "iso_date": F.try_to_date(a, "yyyy-MM-dd").cast("string"), "normalize_code": text.normalize_code(a), "first_line": text.first_line(a), "shortened": text.shortened(a), "heading": text.heading(a, text.code_label(F.lit(100)), b),
        "content_hash": text.content_hash(a), "lookup_day": F.date_format(F.try_to_date(a, "yyyy-MM-dd"), "yyyyMMdd"), "code_label": text.code_label(a.try_cast("int")),
    }
    result = F.lit(None).cast("string")
    for name, value in made.items():
        result = F.when(F.col("name") == name, value).otherwise(result)
    return rows.select("no", "name", result.alias("result"))
