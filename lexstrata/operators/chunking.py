"""Law bodies to searchable chunks: text assembly from nested units and the size rule for splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexstrata.functions.text import article_code, article_label, content_hash, heading, lenient_date
from lexstrata.operators import variants

SPLIT_AT = 6000
# The indent of each level below the unit.
INDENTS = {"항": "", "호": "  ", "목": "    "}
DEFAULT_REVISION = "일부개정"

META_SCHEMA = "body_id long, law_id string, law_name string, enforcement_text string, promulgation_text string, revision_type string, ministry string"
# The names of a body's basic facts.
META_FIELDS = ("법령ID", "법령명_한글", "시행일자", "공포일자", "제개정구분", "소관부처")


def body_meta(bodies: DataFrame, body_id: str = "body_id", body: str = "body") -> DataFrame:
    """Basic facts of each readable body; a blank revision type is the default one; dates that aren't yyyyMMdd once their white space is gone are null."""
    import pyarrow as pa

    schema = pa.schema([("body_id", pa.int64()), *[(n, pa.string()) for n in ("law_id", "law_name", "enforcement_text", "promulgation_text", "revision_type", "ministry")]])

    def read(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                facts = _facts(variants.readable(text))
                if facts is not None:
                    rows.append((i, *(variants.plain_text(facts.fields.get(n)) for n in META_FIELDS)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    raw = bodies.select(F.col(body_id).cast("long"), F.col(body).cast("string")).mapInArrow(read, META_SCHEMA)
    day = lambda c: lenient_date(F.regexp_replace(c, r"(?U)\s+", ""))
    return raw.select(
        "body_id", "law_id", "law_name", day("enforcement_text").alias("enforcement_date"), day("promulgation_text").alias("promulgation_date"),
        F.coalesce(F.nullif("revision_type", F.lit("")), F.lit(DEFAULT_REVISION)).alias("revision_type"), "ministry",
    )


UNIT_SCHEMA = "record_id long, law_id string, law_name string, enforcement_text string, jo_pos int, label_no string, branch_no string, flag string, title string, text string, paragraphs array<struct<hang_pos int, text string>>"


def _facts(root) -> variants.Shape | None:
    law = root.fields.get("법령") if isinstance(root, variants.Shape) else None
    facts = law.fields.get("기본정보") if isinstance(law, variants.Shape) else None
    return facts if isinstance(facts, variants.Shape) else None


def _unit_rows(batches):
    """(record_id, body) to one row a unit: the body's facts, the unit's fields, its lines and those of each of its paragraphs that has any."""
    import pyarrow as pa

    text = pa.string()
    parts = pa.list_(pa.struct([("hang_pos", pa.int32()), ("text", text)]))
    schema = pa.schema([("record_id", pa.int64()), ("law_id", text), ("law_name", text), ("enforcement_text", text), ("jo_pos", pa.int32()), ("label_no", text), ("branch_no", text), ("flag", text), ("title", text), ("text", text), ("paragraphs", parts)])
    plain = variants.plain_text
    for batch in batches:
        rows = []
        for record, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            root = variants.readable(body.as_py())
            facts = _facts(root)
            if facts is None:
                continue
            basic = [plain(facts.fields.get(n)) for n in META_FIELDS[:3]]
            units: dict[int, tuple] = {}
            for level, at, shape in sorted(variants.walk_root(root), key=lambda x: x[1]):
                if level == 0:
                    own = (plain(shape.fields.get(f)) for f in (variants.LEVEL_FIELDS[variants.LEVELS[0]][1], variants.BRANCH, variants.UNIT_FLAG, variants.UNIT_TITLE))
                    units[at[0]] = (*own, [], {})
                label = variants.LEVELS[level]
                if line := plain(shape.fields.get(variants.LEVEL_FIELDS[label][0])):
                    *_, whole, paragraphs = units[at[0]]
                    whole.append(INDENTS.get(label, "") + line)
                    if level:
                        paragraphs.setdefault(at[1], []).append(whole[-1])
            for place, (*own, whole, paragraphs) in units.items():
                rows.append((record, *basic, place, *own, "\n".join(whole) or None, [{"hang_pos": k, "text": "\n".join(v)} for k, v in paragraphs.items()]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def assembled_units(bodies: DataFrame, body_id: str = "body_id", body: str = "body") -> DataFrame:
    """One row a unit of every readable body with its text: each line of the unit and of what is below it in order, indented by level, empty ones left out.

    A unit's own text is its first line. paragraphs: the lines of each paragraph that has any, by its place. A body is parsed once and nothing is
    shuffled; repeated bodies should be dropped before.
    """
    return bodies.select(F.col(body_id).cast("long"), F.col(body).cast("string")).mapInArrow(_unit_rows, UNIT_SCHEMA)


def article_chunks(bodies: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """Chunks of all article units: one a unit, and for a unit longer than split_at one a non-empty paragraph too.

    (record_id, law_id, article_no, paragraph_no, is_parent, title, content, content_hash, valid_from). Units that aren't articles or have no
    text are dropped; a paragraph keeps its place as its number, so numbers may have gaps; the unit's own first line is in no
    paragraph's chunk. A long unit without paragraphs stays whole.
    """
    units = assembled_units(bodies.dropDuplicates(["body_id", "body"]))
    units = units.where(F.coalesce("flag", F.lit("")).isin("", "조문") & F.col("text").isNotNull())
    head = heading(F.col("law_name"), article_label("label_no", "branch_no"), F.col("title"))
    content = lambda t: F.concat(head, F.lit("\n"), t)
    cut = (F.length(content(F.col("text"))) > split_at) & (F.size("paragraphs") > 0)
    whole = F.struct(F.lit(0).alias("hang_pos"), F.col("text").alias("text"))
    parts = F.when(cut, F.concat(F.array(whole), F.col("paragraphs"))).otherwise(F.array(whole))
    rows = units.withColumn("is_cut", F.coalesce(cut, F.lit(False))).withColumn("part", F.explode(parts)).withColumn("content", content(F.col("part.text")))
    return rows.select(
        "record_id", "law_id", article_code("label_no", "branch_no").alias("article_no"), F.nullif("part.hang_pos", F.lit(0)).cast(T.IntegerType()).alias("paragraph_no"),
        (F.col("is_cut") & (F.col("part.hang_pos") == 0)).alias("is_parent"), "title", "content", content_hash("content").alias("content_hash"),
        lenient_date(F.regexp_replace("enforcement_text", r"(?U)\s+", "")).alias("valid_from"),
    )


def indexable(ledger: DataFrame, point: str = "qdrant_point_id", pending_only: bool = False) -> DataFrame:
    """Current rows that aren't the parent of any row; pending_only: of those the ones without a point yet."""
    parents = ledger.where(F.col("parent_article_pk").isNotNull()).select(F.col("parent_article_pk").alias("id")).distinct()
    rows = ledger.where("is_current").join(parents, "id", "left_anti")
    return rows.where(F.col(point).isNull()) if pending_only else rows
