"""Landed files as DataFrames: law bodies, change feeds, sweep logs, requirement answers, catalogue sheets.

What the network delivers is landed first; Spark reads the landing folder. Schemas are given, never inferred, and codes
stay strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("dcerCfrmLworCd", "dcerCfrmLworNm", "reqApreIttCd", "reqApreIttNm", "reqCfrmIstmNm", "aplyStrtDt", "bfhnAffcRtmTpcd")])
PROGRESS = T.StructType([T.StructField("hs", T.StringType()), T.StructField("tpcd", T.StringType()), T.StructField("items", T.ArrayType(ITEM))])
CHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("법령ID", "법령일련번호", "시행일자", "공포일자", "제개정구분명")])


def law_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): one row a file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def sweep_log(spark: SparkSession, path: str) -> DataFrame:
    """(hs, tpcd, items): JSON lines; torn lines are dropped."""
    return spark.read.schema(PROGRESS).option("mode", "DROPMALFORMED").json(path).where(F.col("hs").isNotNull())


def change_pages(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed change pages, one row each; a page's `law` may be absent, null, one object or a list."""
    pages = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    law = F.try_variant_get("v", "$.LawSearch.law", "variant")
    kind = F.schema_of_variant(law)
    each = F.when(law.isNull() | F.is_variant_null(law), F.array().cast("array<variant>")).when(kind.startswith("ARRAY"), F.try_variant_get(law, "$", "array<variant>")).otherwise(F.array(law))
    rows = pages.where(F.col("v").isNotNull()).select(F.explode(each).alias("e"))
    return rows.select(*[F.try_variant_get("e", f"$['{f.name}']", "string").alias(f.name) for f in CHANGE])


# The codes by which the requirement service says that the day's quota is used up, and the code of success.
QUOTA_CODES = ("22", "23")
SUCCESS = "00"


def requirement_answer(df: DataFrame, xml: str) -> DataFrame:
    """df with `answer`, a requirement answer in XML read: status 'ok', 'quota' (try again another day) or 'error', reason, and items (one item is a list of one)."""
    text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
    one = lambda name, of: T.StructType([T.StructField(name, of)])
    schema = T.StructType([
        T.StructField("header", text("resultCode", "resultMsg")),
        T.StructField("body", one("items", one("item", T.ArrayType(ITEM)))),
        T.StructField("cmmMsgHeader", text("returnReasonCode", "returnAuthMsg", "errMsg")),  # of a gateway's own answer
    ])
    read = df.withColumn("__x", F.from_xml(F.col(xml), schema))
    code = F.trim(F.coalesce("__x.header.resultCode", "__x.cmmMsgHeader.returnReasonCode", F.lit("")))
    status = F.when(code.isin(*QUOTA_CODES), "quota").when(code == SUCCESS, "ok").otherwise("error")
    reason = F.when(code != SUCCESS, F.coalesce("__x.header.resultMsg", "__x.cmmMsgHeader.returnAuthMsg", "__x.cmmMsgHeader.errMsg", code))
    items = F.coalesce(F.filter("__x.body.items.item", lambda i: i.isNotNull()), F.array().cast(T.ArrayType(ITEM)))
    return read.withColumn("answer", F.struct(status.alias("status"), reason.alias("reason"), F.when(code == SUCCESS, items).otherwise(F.array().cast(T.ArrayType(ITEM))).alias("items"))).drop("__x")


def read_through(spark: SparkSession, cache: str, make: Callable[[], DataFrame], use_cache: bool = True) -> DataFrame:
    """The table cached in a folder; where there's none, or the cache isn't to be used, what make() gives, which is cached."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache, "_SUCCESS")
    if not (use_cache and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)):
        make().write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def sheets(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """CSV exports of the catalogue's sheets, every column a string so that leading zeros stay; a quote inside a quoted field stands doubled."""
    return [spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True).csv(p) for p in paths]


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells): the rows of all sheets of XLSX workbooks, cells as strings by their column, null where empty.

    A workbook is a zip of XML parts and is read whole by one task; numbers come as they are stored, so codes must be stored as texts to keep leading zeros.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_workbook_rows, "path string, sheet string, row_no int, cells array<string>")


def _workbook_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = list(_sheets_of(content.as_py()))
            if rows:
                names, numbers, cells = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(names), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], ["path", "sheet", "row_no", "cells"])


def _sheets_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    import posixpath
    import zipfile
    from io import BytesIO
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2]
    texts = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(BytesIO(content)) as book:
        part = lambda name: ElementTree.fromstring(book.read(name))
        shared = [texts(s) for s in part("xl/sharedStrings.xml") if local(s) == "si"] if "xl/sharedStrings.xml" in book.namelist() else []
        targets = {r.get("Id"): posixpath.normpath(posixpath.join("/xl", r.get("Target"))).lstrip("/") for r in part("xl/_rels/workbook.xml.rels")}
        for sheet in (s for s in part("xl/workbook.xml").iter() if local(s) == "sheet"):
            ref = next(v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id")
            for n, row in enumerate((r for r in part(targets[ref]).iter() if local(r) == "row"), 1):
                cells: dict[int, str | None] = {}
                for at, cell in enumerate(c for c in row if local(c) == "c"):
                    letters = (cell.get("r") or "").rstrip("0123456789")
                    column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else at
                    value = next((v.text for v in cell if local(v) == "v"), None)
                    kind = cell.get("t")
                    cells[column] = texts(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
                yield sheet.get("name"), int(row.get("r") or n), [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def workbook_sheets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(path, sheet, and the columns) of the rows of a workbook behind each sheet's first row, which holds headers; a sheet of another width raises."""
    wide = F.raise_error(F.lit("a sheet has more columns than expected"))
    cell = lambda i: F.when(F.size("cells") > len(columns), wide).otherwise(F.try_element_at("cells", F.lit(i + 1)))
    return rows.where("row_no > 1").select("path", "sheet", *[cell(i).alias(c) for i, c in enumerate(columns)])


# The leaf sheet's headers and the attributes they hold.
LEAF_HEADERS = {"HS부호": "code", "적용시작일자": "valid_from", "적용종료일자": "valid_to", "수량단위코드": "quantity_unit", "중량단위코드": "weight_unit", "성질통합분류코드": "category_code", "성질통합분류코드명": "category_name"}


def leaf_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Ten-digit leaves with their attributes, dates as ISO strings (null if they aren't dates); other codes are left out, a leaf given twice raises."""
    raw = sheets(spark, [path])[0].select(*[F.col(h).alias(n) for h, n in LEAF_HEADERS.items()]).withColumn("code", F.trim("code"))
    iso = lambda c: F.date_format(F.coalesce(F.try_to_date(F.col(c), "yyyyMMdd"), F.try_to_date(F.col(c), "yyyy-MM-dd")), "yyyy-MM-dd")
    twice = F.count(F.lit(1)).over(W.partitionBy("code")) > 1
    leaves = raw.where(F.length("code") == 10).withColumn("code", F.when(twice, F.raise_error(F.concat(F.lit("leaf given twice: "), F.col("code")))).otherwise(F.col("code")))
    return leaves.withColumns({"valid_from": iso("valid_from"), "valid_to": iso("valid_to")})


WALK_SCHEMA = "place string, kind string, size int"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import json

    for batch in batches:
        out = []
        for body in batch.column(0).to_pylist():
            try:
                stack = [("", json.loads(body or ""), 0)]
            except (ValueError, RecursionError):
                continue
            while stack:
                place, value, depth = stack.pop()
                while isinstance(value, list):
                    value = value[0] if value else None
                for k, v in value.items() if isinstance(value, dict) else ():
                    at = f"{place}/{re.sub(r'[ \t\n\r\f]', '', k)}"
                    out.append((at, type(v).__name__, len(v) if isinstance(v, (list, dict)) else None))
                    if depth < WALK_DEPTH:
                        stack.append((at, v, depth + 1))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], ["place", "kind", "size"])


WALK_DEPTH = 3


def structure_walk(df: DataFrame, body: str) -> DataFrame:
    """(place, kind, n, least, most): what stands at each place of the JSON bodies down to WALK_DEPTH, of lists in the first element only: kinds, how often, and sizes of lists and objects. Torn bodies don't count."""
    rows = df.select(F.col(body).cast("string")).mapInArrow(_walk, WALK_SCHEMA)
    return rows.groupBy("place", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))


def structure(df: DataFrame, body: str) -> str:
    """The merged schema of a JSON column."""
    return df.select(F.schema_of_variant_agg(F.try_parse_json(body))).first()[0]


def find_law(laws: DataFrame, name: str) -> DataFrame:
    """The law of a name, white space set aside: the least id, or no row."""
    from lexstrata.functions.text import squash

    return laws.where(squash("law_name") == squash(F.lit(name))).orderBy("law_id").limit(1)


def find_laws(laws: DataFrame, names: DataFrame) -> DataFrame:
    """(name, law_id) of every name asked for (name), white space set aside: the least id; null where there's no such law."""
    from lexstrata.functions.text import squash

    known = laws.groupBy(squash("law_name").alias("key")).agg(F.min("law_id").alias("law_id"))
    return names.select("name").distinct().withColumn("key", squash("name")).join(known, "key", "left").select("name", "law_id")


def current_versions(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(law_id, mst): the last version id (by seq) that search results (law_id, mst, seq) give for each law asked for (law_id); a law without any raises."""
    last = found.where(F.col("mst").isNotNull()).groupBy("law_id").agg(F.max_by("mst", "seq").alias("mst"))
    none = F.raise_error(F.concat(F.lit("no version of law "), F.col("law_id")))
    return asked.select("law_id").distinct().join(last, "law_id", "left").select("law_id", F.coalesce("mst", none).alias("mst"))


def current_version(found: DataFrame, law_id: str) -> str:
    """The version id of one law; LookupError if the search results hold none."""
    row = found.where((F.col("law_id") == law_id) & F.col("mst").isNotNull()).agg(F.max_by("mst", "seq")).first()
    if row[0] is None:
        raise LookupError(f"no version of law {law_id}")
    return row[0]
