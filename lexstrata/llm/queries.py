"""Queries of the text problems (1, 3, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexstrata.functions.text import digits_of
from lexstrata.llm import contamination, longspans, normalize, packing, split
from lexstrata.operators.snapdiff import latest_rows
from lexstrata.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).select("article_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of the rows that lack usable chunks."""
    return split.split_articles(table(spark, d, "law_articles"))


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any split: pieces above the limit, places that don't meet, and the hash of the pieces put together without their overlaps."""
    at = F.struct("piece_no", "start_at", "end_at", "piece")
    rows = p1_pieces(spark, d).groupBy("article_id").agg(F.sort_array(F.collect_list(at)).alias("p"))  # the pieces of one row
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), F.lit(0), lambda n, i: n + (F.element_at("p", i)["end_at"] - split.OVERLAP + 1 != F.element_at("p", i + 1)["start_at"]).cast("int"))
    text = F.array_join(F.transform("p", lambda x: F.when(x["piece_no"] == 1, x["piece"]).otherwise(F.substring(x["piece"], split.OVERLAP + 1, split.LIMIT))), "")
    over = F.size(F.filter("p", lambda x: F.length(x["piece"]) > split.LIMIT))
    return rows.select("article_id", over.alias("n_over"), F.when(F.size("p") > 1, gaps).otherwise(0).alias("n_gaps"), F.sha2(text, 256).alias("text_hash"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "law_articles").where(F.col("deleted_at").isNull())
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    group = F.concat_ws(":", part("law_id"), part("article_no"), part("paragraph_no"))
    return normalize.look_alike_classes(live, group, "id", "content")


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Each article row that looks like others: its class of equal texts and how many rows look the same in other characters."""
    return normalize.look_alike_members(p3_classes(spark, d)).select(F.col("id").alias("row_id"), "class_id", "n_links")


#: Texts, and their consistent form as it was worked out by hand.
CASES = (
    ("１２ＡＢｃｄ", "12ABcd"), ("수입　물품", "수입 물품"), ("수입\u200b물품", "수입물품"), ("\ufeff관세\u00ad", "관세"), ("수입\u00a0물품", "수입 물품"), ("\u1112\u1161\u11ab", "한"), ("e\u0301", "é"), ("Α", "A"),
    ("ｶ", "カ"), ("제１조ㆍ제２조", "제1조ㆍ제2조"), ("제1조·제2조", "제1조ㆍ제2조"), ("“가”", '"가"'), ("m²", "m²"), ("m2", "m2"), ("㎡", "㎡"), ("①", "①"), ("  두 칸", "  두 칸"), ("", ""), ("⼀", "一"), ("а", "a"), ("１，０００", "1,000"),
)


def p3_cases(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of texts whose form is known."""
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "no int, stored string")
    return normalize.normalize_text(texts, {"stored": "form"}).select("no", "form")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """How many names of the catalogue there are as stored and in the consistent form, per snapshot."""
    names = normalize.normalize_text(table(spark, d, "hs_node_snapshots").select("snapshot_date", "name_ko"), {"name_ko": "form"})
    return names.groupBy("snapshot_date").agg(F.count_distinct("name_ko").alias("n_stored"), F.count_distinct("form").alias("n_forms"))


def p3_articles(spark: SparkSession, d: str) -> DataFrame:
    return normalize.look_alike_pairs(p3_classes(spark, d))


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "hs_node_snapshots")
    rows = latest_rows(nodes, digits_of("code"), "snapshot_date", F.struct("row_id", "name_ko"), F.col("loaded_at"), [F.col("row_id")])
    rows = rows.select("key", "day", F.col("value.row_id").alias("row_id"), F.col("value.name_ko").alias("name"))
    days = nodes.select(F.col("snapshot_date").alias("day")).where(F.col("day").isNotNull()).distinct()
    pairs = days.select("day", F.lead("day").over(W.orderBy("day")).alias("next_day"))  # a DATE has a bounded number of values
    before = rows.join(F.broadcast(pairs), "day").select("key", F.col("next_day").alias("day"), F.col("row_id").alias("id1"), F.col("name").alias("n1"))
    met = before.join(rows, ["key", "day"]).where("n1 <> name and id1 <> row_id").select("id1", F.col("row_id").alias("id2"), "n1", F.col("name").alias("n2"))
    forms = normalize.with_sql(met, {"f1": normalize.form_sql("n1"), "f2": normalize.form_sql("n2")}, ["id1", "id2"])
    return forms.where("f1 = f2").select(F.least("id1", "id2").alias("lo_id"), F.greatest("id1", "id2").alias("hi_id")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    articles = p3_articles(spark, d).select(F.lit("law_articles").alias("src"), "lo_id", "hi_id")
    return articles.unionByName(p3_names(spark, d).select(F.lit("hs_node_snapshots").alias("src"), "lo_id", "hi_id"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The documents in containers of 8,192 tokens, by their n_tokens (of the public byte-level tokenizer); no text is read."""
    docs = table(spark, d, "documents")
    return packing.fill_containers(docs, "doc_id", F.col("n_tokens")).select("container_id", F.col("item_id").alias("doc_id"), "piece_no", "first_unit", "units")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: each document's pieces and tokens, and whether one of its containers is above the capacity."""
    got = p8_containers(spark, d)
    over = got.groupBy("container_id").agg((F.sum("units") > packing.CAPACITY).alias("over"))
    return got.join(over, "container_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("units").alias("n_tokens"), F.max("over").alias("overfull"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: at most 2 % and one more of them than the tokens need."""
    got = p8_containers(spark, d).agg(F.count_distinct("container_id").alias("n"), F.coalesce(F.sum("units"), F.lit(0)).alias("n_tokens"))
    return got.select("n_tokens", (F.col("n") <= F.ceil(F.col("n_tokens") / packing.CAPACITY) * 1.02 + 1).alias("well_filled"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents, where they leak, and their text without it."""
    return contamination.leaking_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The items that each leaking document shows, with automata of a tenth of the items each."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    found = contamination.leaking_documents(docs, items, block_chars=contamination.MIN_RUN * 60)
    return found.select("doc_id", "items").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return longspans.shared_stretches(table(spark, d, "documents"))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared."""
    return longspans.shared_report(table(spark, d, "documents"), p10_found(spark, d))


P1_SQL = r"""
WITH live AS (SELECT * FROM law_articles WHERE deleted_at IS NULL),
big AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM live WHERE length(content) > 6000),
sub AS (SELECT DISTINCT parent_article_pk AS id, unnest(string_split(content, chr(10))) AS line FROM live WHERE parent_article_pk IS NOT NULL)
SELECT DISTINCT id AS article_id FROM big WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.id = big.id AND sub.line = big.line)
"""

_DIGITS = "nullif(regexp_replace(translate(code, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '')"

P3_SQL = f"""
WITH a AS (SELECT DISTINCT id, law_id, article_no, paragraph_no, content, {normalize.form_sql("content")} AS form FROM law_articles WHERE deleted_at IS NULL),
n AS (SELECT row_id, {_DIGITS} AS code, snapshot_date, name_ko FROM hs_node_snapshots WHERE {_DIGITS} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_date, {_DIGITS} ORDER BY loaded_at DESC, row_id DESC) = 1),
days AS (SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS after FROM (SELECT DISTINCT snapshot_date FROM hs_node_snapshots)),
m AS (SELECT x.row_id AS r1, y.row_id AS r2, x.name_ko AS n1, y.name_ko AS n2 FROM n x JOIN days USING (snapshot_date) JOIN n y ON y.code = x.code AND y.snapshot_date = days.after WHERE x.name_ko <> y.name_ko)
SELECT DISTINCT 'law_articles' AS src, x.id AS lo_id, y.id AS hi_id FROM a x JOIN a y
  ON x.law_id IS NOT DISTINCT FROM y.law_id AND x.article_no IS NOT DISTINCT FROM y.article_no AND x.paragraph_no IS NOT DISTINCT FROM y.paragraph_no AND x.form = y.form AND x.content <> y.content AND x.id < y.id
UNION ALL SELECT DISTINCT 'hs_node_snapshots', least(r1, r2), greatest(r1, r2) FROM m WHERE {normalize.form_sql("n1")} = {normalize.form_sql("n2")}
"""

P9_SQL = f"""
WITH i AS (SELECT item_id, {normalize.letters_sql("text")} AS f FROM eval_items), d AS (SELECT doc_id, {normalize.letters_sql("text")} AS f FROM documents),
ig AS (SELECT DISTINCT item_id, substring(f, k, 50) AS g FROM (SELECT *, unnest(range(1, length(f) - 48)) AS k FROM i)),
dg AS (SELECT DISTINCT doc_id, substring(f, k, 50) AS g FROM (SELECT *, unnest(range(1, length(f) - 48)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

P10_SQL = """
WITH w AS (SELECT doc_id, k, hash(substring(text, k, 200)) AS g FROM (SELECT DISTINCT doc_id, text, unnest(range(1, length(text) - 198)) AS k FROM documents)),
s AS (SELECT doc_id, k FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING min(doc_id) <> max(doc_id))),
m AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM m)
SELECT doc_id, min(k)::INT AS start_at, (max(k) - min(k) + 200)::INT AS span_len FROM r GROUP BY doc_id, run
"""

P8_SQL = "SELECT doc_id, greatest(1, ceil(n_tokens / 8192))::BIGINT AS n_pieces, n_tokens::BIGINT AS n_tokens, false AS overfull FROM documents"

P1_REJOINED_SQL = f"SELECT DISTINCT id AS article_id, 0 AS n_over, 0 AS n_gaps, sha256(content) AS text_hash FROM law_articles WHERE deleted_at IS NULL AND length(content) > 6000 AND id IN ({P1_SQL})"

_P3_KEY = "law_id, article_no, paragraph_no, form"
P3_MEMBERS_SQL = f"""
WITH m AS (SELECT DISTINCT id, law_id, article_no, paragraph_no, content, {normalize.form_sql("content")} AS form FROM law_articles WHERE deleted_at IS NULL AND id IS NOT NULL AND content IS NOT NULL)
SELECT id AS row_id, min(id) OVER (PARTITION BY {_P3_KEY}, content) AS class_id, count(*) OVER (PARTITION BY {_P3_KEY}) - count(*) OVER (PARTITION BY {_P3_KEY}, content) AS n_links
FROM m QUALIFY n_links > 0
"""
P3_CASES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {normalize.quoted(form)})" for i, (_, form) in enumerate(CASES)) + ") v(no, form)"
P3_FORMS_SQL = f"SELECT snapshot_date, count(DISTINCT name_ko) AS n_stored, count(DISTINCT {normalize.form_sql('name_ko')}) AS n_forms FROM hs_node_snapshots GROUP BY snapshot_date"
P8_FILL_SQL = "SELECT coalesce(sum(n_tokens), 0)::BIGINT AS n_tokens, true AS well_filled FROM documents"
P9_LEAKS_SQL = f"SELECT doc_id, list_sort(list(item_id)) AS items FROM ({P9_SQL}) GROUP BY doc_id"
P10_REPORT_SQL = f"""
SELECT doc_id, n_chars, coalesce(n, 0) AS n_stretches, coalesce(chars, 0)::BIGINT AS shared_chars, CASE WHEN n_chars > 0 THEN round(coalesce(chars, 0) / n_chars, 6) ELSE 0 END::DOUBLE AS share
FROM (SELECT doc_id, coalesce(max(length(text)), 0)::INT AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, sum(span_len) AS chars FROM ({P10_SQL}) GROUP BY doc_id) USING (doc_id)
"""

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_rejoined, p3_found, p3_members, p3_cases, p3_forms, p8_containers, p8_documents, p8_fill, p9_found, p9_leaks, p9_cleaned, p10_found, p10_report)
}
SQL = {
    "p1_found": P1_SQL, "p1_rejoined": P1_REJOINED_SQL, "p3_found": P3_SQL, "p3_members": P3_MEMBERS_SQL, "p3_cases": P3_CASES_SQL, "p3_forms": P3_FORMS_SQL,
    "p8_documents": P8_SQL, "p8_fill": P8_FILL_SQL, "p9_found": P9_SQL, "p9_leaks": P9_LEAKS_SQL, "p10_found": P10_SQL, "p10_report": P10_REPORT_SQL,
}
