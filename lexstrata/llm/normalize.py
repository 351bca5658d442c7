"""Text that looks the same brought to one form, by embedded SQL over Arrow partitions.

Every Arrow batch is handed to a DuckDB in the Python worker, which removes invisible characters (regular
expression), maps compatibility forms, spaces and look-alikes (translate) and composes accents and syllables
(nfc_normalize). Texts without any character that could change, told by one regular expression, skip all three.

Width, encoding, invisible characters and the choice among like-looking letters, ideographs and marks vanish;
number of spaces, case, raised, lowered and circled figures and unit signs stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexstrata.session import cut_lineage

# Ranges of characters without any visible form (Unicode's Default_Ignorable_Code_Point).
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Letters of other scripts and the Latin letters they look like.
LETTERS = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ": "ABEZHIKMNOPTYXC",
    "οϲϳ": "ocj",
    "АВЕЅІЈКМНОРСТУХҮԌԚԜҺӀ": "ABESIJKMHOPCTYXYGQWhI",
    "аеѕіјорсухһԛԝԁ": "aesijopcyxhqwd",
}

# Marks that look alike; the first of each group stands for all.
MARKS = (
    "ㆍ·‧・•∙⋅᛫ꞏ･",
    "-‐‑‒–−﹣⁃",
    "~∼〜˜⁓",
    "'‘’‛′＇ʹʼ`´",
    '"“”‟″＂ʺ',
    ",‚﹐",
    ".․﹒",
    ":∶˸﹕",
    ";;﹔",
    "/⁄∕",
    "|∣ǀ❘",
    "*∗﹡",
    "〈⟨〈‹",
    "〉⟩〉›",
    "《⟪",
    "》⟫",
    "—―─",
    "×✕⨯",
)

_TOP = sys.maxunicode + 1


def _ranges(points: Iterable[int]) -> str:
    """A regular expression's class of code points, as RE2 and Java write it."""
    out: list[list[int]] = []
    for p in sorted(set(points)):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in out) + "]"


@cache
def invisible_points() -> frozenset[int]:
    return frozenset(p for a, b in INVISIBLE for p in range(a, b + 1))


@cache
def look_map() -> dict[str, str]:
    """Each character that another one stands for, by rule: width, spaces, radicals, look-alikes, and precomposed letters on such a base."""
    base: dict[str, str] = {}
    for many, one in LETTERS.items():
        base |= dict(zip(many, one, strict=True))
    for group in MARKS:
        base |= {c: group[0] for c in group[1:]}
    hidden = invisible_points()

    def image(c: str) -> str:
        kind, _, points = unicodedata.decomposition(c).partition(" ")
        if unicodedata.category(c) == "Zs":
            return " "
        if kind in ("<wide>", "<narrow>", "<noBreak>") or kind == "<compat>" and 0x2E80 <= ord(c) <= 0x2FDF:
            c = "".join(chr(int(p, 16)) for p in points.split())
        return base.get(c, c)

    out = {}
    for p in range(0x80, _TOP):
        if p in hidden or 0xD800 <= p <= 0xDFFF or 0xAC00 <= p <= 0xD7A3:
            continue
        c = chr(p)
        to = image(c)
        if to == c and (whole := unicodedata.normalize("NFD", c)) != c:
            if len(whole) > 1 or image(whole) != whole:
                to = unicodedata.normalize("NFC", "".join(map(image, whole)))
                if to == unicodedata.normalize("NFC", c):
                    to = c  # composition alone does it
        if to != c:
            out[c] = to
    for c, to in base.items():
        if ord(c) < 0x80:
            out[c] = to
    return {c: to for c, to in out.items() if len(to) == 1}


@cache
def composing_points() -> frozenset[int]:
    """Characters that canonical composition may change or join to the one before."""
    out = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for p in range(0x80, _TOP):
        if 0xD800 <= p <= 0xDFFF or 0xAC00 <= p <= 0xD7A3:
            continue
        c = chr(p)
        if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c:
            out.add(p)
        kind = unicodedata.decomposition(c).split()
        if len(kind) == 2 and kind[0][0] != "<":
            out.add(int(kind[1], 16))
    return frozenset(out)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def form_sql(column: str) -> str:
    """The consistent form of a text column as DuckDB SQL; null stays null."""
    table = look_map()
    touched = {ord(c) for c in table} | invisible_points() | composing_points()
    source, target = "".join(table), "".join(table.values())
    hidden = f"regexp_replace({column}, '{_ranges(invisible_points())}+', '', 'g')"
    return f"CASE WHEN regexp_matches({column}, '{_ranges(touched)}') THEN nfc_normalize(translate({hidden}, {quoted(source)}, {quoted(target)})) ELSE {column} END"


@cache
def letters_sql(column: str) -> str:
    """The consistent form in lower case, letters and digits only."""
    return f"regexp_replace(lower({form_sql(column)}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@cache
def _python_table() -> dict[int, str | None]:
    return {p: None for p in invisible_points()} | {ord(c): to for c, to in look_map().items()}


def form_of(text: str) -> str:
    """The same form in Python, for a single text."""
    return unicodedata.normalize("NFC", text.translate(_python_table()))


class BatchSql:
    """Adds columns computed by DuckDB to every Arrow batch of a partition.

    exprs: {new column: SQL over the batch's columns}. keep: the columns passed on.
    """

    def __init__(self, exprs: dict[str, str], keep: list[str]):
        self.exprs, self.keep = exprs, keep

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": True}) as db:
            query = "SELECT " + ", ".join(f'{x} AS "{n}"' for n, x in self.exprs.items()) + " FROM batch"
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = pa.Table.from_batches([batch])
                texts = [i for i, f in enumerate(rows.schema) if pa.types.is_string(f.type) or pa.types.is_large_string(f.type)]
                db.register("batch", rows.select(texts))
                made = db.sql(query).to_arrow_table()
                db.unregister("batch")
                out = rows.select(self.keep)
                for name in self.exprs:
                    out = out.append_column(name, made[name])
                yield out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in self.run(batches):
            yield from table.combine_chunks().to_batches()


def with_sql(df: DataFrame, exprs: dict[str, str], keep: list[str]) -> DataFrame:
    """keep's columns of df and new string columns, each given as DuckDB SQL over df's string columns."""
    schema = T.StructType([*[df.schema[k] for k in keep], *[T.StructField(n, T.StringType()) for n in exprs]])
    return df.mapInArrow(BatchSql(exprs, keep), schema)


def normalize_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a new column of the consistent form for each {text column: new name}.

    Null stays null, empty stays empty, texts are taken whole. A new name that df already has raises ValueError.
    """
    if clash := {*columns.values()} & {*df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return with_sql(df, {new: form_sql(f'"{old}"') for old, new in columns.items()}, df.columns)


def look_alike_classes(rows: DataFrame, group: Column, row_id: str, text: str) -> DataFrame:
    """(id, k, raw): the members of all classes of equal texts (raw) whose form (k: group and form) other texts of the group have too; distinct.

    Rows with a null text or id are left out; an id delivered repeatedly is one row for each of its texts. Forms of which all
    texts agree are dropped by an aggregate combined map-side before anything is joined.
    """
    picked = rows.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).alias("id"), group.alias("grp"), F.col(text).alias("t"))
    hashed = with_sql(picked, {"raw": "md5(t)", "form": f"md5({form_sql('t')})"}, ["id", "grp"])
    hashed = cut_lineage(hashed.select("id", F.md5(F.concat_ws("\x1f", "grp", "form")).alias("k"), "raw"))
    mixed = hashed.groupBy("k").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("k")
    return hashed.join(mixed, "k", "left_semi").distinct()


def look_alike_members(classes: DataFrame) -> DataFrame:
    """(id, class_id, n_links) of look_alike_classes: the least id with the same text and form, and how many rows of the
    form have another text. One row a member and form, however many it looks like: what to use where copies are many."""
    sizes = classes.groupBy("k", "raw").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("own"))
    totals = sizes.groupBy("k").agg(F.sum("own").alias("all"))
    return classes.join(sizes.join(totals, "k"), ["k", "raw"]).select("id", "class_id", (F.col("all") - F.col("own")).alias("n_links"))


def look_alike_pairs(classes: DataFrame) -> DataFrame:
    """(lo_id, hi_id) of look_alike_classes: rows that have the same form but other characters; distinct, smaller id first.

    Classes are met with classes first: copies meet only the other classes' rows, as the result requires.
    """
    each = classes.select("k", "raw").distinct()
    other = each.join(each.withColumnRenamed("raw", "raw2"), "k").where("raw <> raw2")
    left = classes.join(other, ["k", "raw"]).select("k", "raw2", F.col("id").alias("lo_id"))
    right = classes.select("k", F.col("raw").alias("raw2"), F.col("id").alias("hi_id"))
    return left.join(right, ["k", "raw2"]).where("lo_id < hi_id").select("lo_id", "hi_id").distinct()
