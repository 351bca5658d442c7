"""Requirements of products: loading sweep results as edges and looking them up, inherited ones too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.text import PREFIXES, digits_of, normalize_code, trim_any

# The two directions of trade.
TRADE_TYPES = {"1": "수출", "2": "수입"}


def sweep_items(progress: DataFrame) -> DataFrame:
    """One row an item of a sweep log, fields trimmed, in an explicit order: (hs, law_code, law_name, agency_code, agency_name, trade_type, valid_from, document, rtm_tpcd, seq).

    seq orders what came first and last: sweep time, record, place in the record; repeated records count once. Rows
    without a direction are left out, an unknown one raises.
    """
    known = F.create_map(*[F.lit(x) for pair in TRADE_TYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(known, trim_any("tpcd")), F.raise_error(F.concat(F.lit("unknown trade direction "), F.col("tpcd"))))
    told = progress.where(F.col("tpcd").isNotNull() & F.col("items").isNotNull() & (F.size("items") > 0))
    rows = told.select("rec_no", "swept_at", digits_of("hs").alias("hs"), kind.alias("trade_type"), F.posexplode("items").alias("place", "i"))
    clean = lambda f: F.coalesce(trim_any(f"i.{f}"), F.lit(""))
    rows = rows.where(F.col("i").isNotNull())
    return rows.select(
        "hs", clean("dcerCfrmLworCd").alias("law_code"), clean("dcerCfrmLworNm").alias("law_name"), clean("reqApreIttCd").alias("agency_code"), clean("reqApreIttNm").alias("agency_name"),
        "trade_type", clean("aplyStrtDt").alias("valid_from"), clean("reqCfrmIstmNm").alias("document"), clean("bfhnAffcRtmTpcd").alias("rtm_tpcd"),
        F.struct("swept_at", "rec_no", "place").alias("seq"),
    ).distinct()


def known_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items of products the catalogue has; others are dropped before any law or agency is made of them."""
    return items.join(products.select(F.col("code").alias("hs")).distinct(), "hs", "left_semi")


def requires_edges(items: DataFrame) -> DataFrame:
    """(hs, law_code, trade_type, valid_from, document, rtm_tpcd): one edge a key, the last writer's."""
    last = F.max_by(F.struct("valid_from", "document", "rtm_tpcd"), "seq")
    return items.groupBy("hs", "law_code", "trade_type").agg(last.alias("e")).select("hs", "law_code", "trade_type", "e.*")


def first_names(items: DataFrame, code: str, name: str) -> DataFrame:
    """(code, name): the first writer's name."""
    return items.groupBy(F.col(code).alias("code")).agg(F.min_by(name, "seq").alias("name"))


def approvals(items: DataFrame) -> DataFrame:
    return items.select("law_code", "agency_code").distinct()


def traverse(edges: DataFrame, laws: DataFrame, approved: DataFrame, agencies: DataFrame) -> DataFrame:
    """Edges with the law's name and all agencies of the law (sorted names); laws without an agency or a name drop out.

    Agencies are gathered per law, a short list, and then joined, so a law that a third of all products need costs no more.
    """
    named = approved.join(agencies.select(F.col("code").alias("agency_code"), F.col("name").alias("agency_name")), "agency_code")
    per_law = named.groupBy("law_code").agg(F.sort_array(F.collect_set("agency_name")).alias("agencies"))
    law = laws.select(F.col("code").alias("law_code"), F.col("name").alias("law_name")).where("law_name <> ''").join(per_law, "law_code")
    return edges.join(law, "law_code")


def lookup(products: DataFrame, paths: DataFrame, trade_type: str | None = None, as_of: str | None = None) -> DataFrame:
    """Direct and inherited requirements of products (code): (hsk10, on_code, source, level, and the path's columns).

    A product's own code and its three prefixes are four equi-join keys; as_of (yyyyMMdd) leaves out what isn't in force
    yet, a blank start always counts; trade_type keeps one direction.
    """
    code = normalize_code("code")
    keys = F.array_distinct(F.array(F.col("hsk10"), *[F.substring("hsk10", 1, n) for n in PREFIXES.values()]))
    asked = products.select(code.alias("hsk10")).distinct().select("hsk10", F.explode(keys).alias("hs"))
    rows = paths
    if trade_type:
        rows = rows.where(F.col("trade_type") == trade_type)
    if as_of:
        rows = rows.where((F.coalesce("valid_from", F.lit("")) == "") | (F.col("valid_from") <= as_of))
    out = asked.join(rows, "hs")
    return out.select("hsk10", F.col("hs").alias("on_code"), F.when(F.col("hs") == F.col("hsk10"), "direct").otherwise("inherited").alias("source"), F.length("hs").alias("level"), *[c for c in paths.columns if c != "hs"])


def lookup_response(products: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """One nested row a product: names, ancestors, and its requirements as an array (empty if there are none).

    Products come from a request, so a row's requirements are few; the name of the product is that of a leaf only.
    """
    code = normalize_code("code")
    out = products.select(code.alias("hsk10")).distinct()
    leaf = nodes.where(F.col("is_leaf")).select(F.col("code").alias("hsk10"), "name_ko", "name_en")
    out = out.join(leaf, "hsk10", "left")
    ancestors = []
    for name, n in PREFIXES.items():
        own = nodes.select(F.col("code").alias(name), F.col("name_ko").alias(f"{name}_name"))
        out = out.withColumn(name, F.substring("hsk10", 1, n)).join(own, name, "left")
        ancestors.append(F.struct(F.col(name).alias("code"), F.col(f"{name}_name").alias("name")).alias(name))
    fields = [c for c in ("trade_type", "law_code", "law_name", "document", "agencies", "valid_from", "source", "level") if c in found.columns]
    per = found.groupBy("hsk10").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("requirements"))
    empty = F.array().cast(per.schema["requirements"].dataType)
    out = out.join(per, "hsk10", "left").select("hsk10", "name_ko", "name_en", F.struct(*ancestors).alias("ancestors"), F.coalesce("requirements", empty).alias("requirements"))
    return out.withColumn("subject", F.size("requirements") > 0)


def response_lines(responses: DataFrame) -> DataFrame:
    """Responses flattened for a list: (hsk10, name_ko, name_en, subject, chain, lines); chain: the ancestors' names that there are, from the chapter down."""
    names = [F.col(f"ancestors.{a}.name") for a in reversed(PREFIXES)]
    line = lambda r: F.concat_ws("|", r["trade_type"], r["law_code"], r["law_name"], r["document"], F.concat_ws(",", r["agencies"]), r["valid_from"], r["source"], r["level"].cast("string"))
    return responses.select("hsk10", "name_ko", "name_en", "subject", F.concat_ws(" › ", *names).alias("chain"), F.sort_array(F.transform("requirements", line)).alias("lines"))


def sweep_todo(products: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """(hs, tpcd): pairs of product and direction that no sweep has done, in order; empty results are done too."""
    kinds = F.explode(F.array(*[F.lit(k) for k in TRADE_TYPES]))
    pairs = products.select(F.col("code").alias("hs")).distinct().select("hs", kinds.alias("tpcd"))
    todo = pairs.join(done.select(digits_of("hs").alias("hs"), trim_any("tpcd").alias("tpcd")).distinct(), ["hs", "tpcd"], "left_anti")
    return todo.orderBy("hs", "tpcd").limit(limit) if limit else todo

