"""Splitting oversized texts at natural boundaries: a sparse-table range-maximum index over boundary strengths.

Every place between two characters has a strength: a paragraph's begin is stronger than an item's, that than a
sub-item's, a line's, a sentence's, a word's. A piece that begins at s ends at the strongest place in
(s + least, s + limit], the rightmost of equals, found in constant time by two overlapping power-of-two ranges;
the next piece begins `overlap` characters before that.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexstrata.session import cut_lineage

LIMIT = 6000
OVERLAP = 200

# What begins a paragraph (circled numbers), an item (1. or 1의2.) and a sub-item (가.) at the start of a line.
PARAGRAPH = r"[①-⑳㉑-㉟㊱-㊿]"
ITEM = r"\d{1,4}(?:의\d{1,3})?\."
SUB_ITEM = r"[가-힣]\."

_LINES = re.compile(rf"\n[ \t]*(?:(?P<p>{PARAGRAPH})|(?P<i>{ITEM})|(?P<s>{SUB_ITEM}))?")
_SENTENCE = re.compile(r"[.!?。][\"'”’)\]」』]*[ \t]+")
_WORD = re.compile(r"\s+")
INSIDE = -1  # within a character and its combining marks: cut there only if there's nothing else
STRENGTHS = {"p": 6, "i": 5, "s": 4}

#: Places indexed at once; bounds the memory for a text of any length.
BLOCK = 1 << 16


def boundary_strengths(text: str) -> np.ndarray:
    """The strength of a cut before each character (index 0 is never used)."""
    out = np.zeros(len(text) + 1, np.int8)
    for m in _WORD.finditer(text):
        out[m.end()] = 1
    for m in _SENTENCE.finditer(text):
        out[m.end()] = 2
    for m in _LINES.finditer(text):
        out[m.start() + 1] = STRENGTHS.get(m.lastgroup, 3)
    if not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        maybe = np.flatnonzero((points >= 0x300) & ((points < 0xAC00) | (points > 0xD7A3)) & ((points < 0x4E00) | (points > 0x9FFF)))
        for i in maybe:
            c = text[i]
            if unicodedata.combining(c) or "ᅠ" <= c <= "ᇿ" or c == "‍" or "︀" <= c <= "️":
                out[i] = INSIDE
    return out


class RangeMaximum:
    """Sparse table: the place of the greatest value in any range, the rightmost of equals."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= len(values):
            left, right = self.levels[-1][:-width], self.levels[-1][width:]
            self.levels.append(np.where(values[right] >= values[left], right, left))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """In lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1])
        return b if self.values[b] >= self.values[a] else a


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces; one piece if the text is within the limit, none if it's empty."""
    if limit < 2 or not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    n, start, out = len(text), 0, []
    least = max(overlap, limit // 2)
    strengths = boundary_strengths(text) if n > limit else None
    base, index = 0, None
    while n - start > limit:
        if index is None or start + limit - base >= len(index.values):
            base = start
            index = RangeMaximum(strengths[base : base + max(BLOCK, 2 * limit)])
        end = base + index.query(start + least + 1 - base, start + limit - base)
        out.append((start, end))
        start = end - overlap
    if n:
        out.append((start, n))
    return out


_MARK = re.compile(rf"(?:^|\n)[ \t]*({PARAGRAPH})")


def paragraph_at(marks: list[tuple[int, int]], place: int) -> int | None:
    """The number of the paragraph that holds the place: of the last mark at or before it."""
    number = None
    for at, value in marks:
        if at > place:
            break
        number = value
    return number


class _Split:
    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, starts, ends, marks, texts = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                paragraphs = [(m.start(1), int(unicodedata.numeric(m.group(1)))) for m in _MARK.finditer(text)]
                for k, (a, b) in enumerate(cut_points(text, self.limit, self.overlap), 1):
                    at.append(row)
                    number.append(k)
                    starts.append(a + 1)
                    ends.append(b)
                    marks.append(paragraph_at(paragraphs, a))
                    texts.append(text[a:b])
            rows = pa.Table.from_batches([batch]).drop_columns(["text"]).take(pa.array(at, pa.int64()))
            for name, values, kind in (("piece_no", number, pa.int32()), ("start_at", starts, pa.int32()), ("end_at", ends, pa.int32()), ("mark_no", marks, pa.int32()), ("piece", texts, pa.string())):
                rows = rows.append_column(name, pa.array(values, kind))
            yield from rows.combine_chunks().to_batches(max_chunksize=1000)


def split_texts(rows: DataFrame, text: Column | str, keys: dict[str, Column], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every row's text: the keys, piece_no from 1, start_at and end_at (from 1, both included), mark_no, piece.

    No piece is longer than the limit, consecutive pieces share exactly `overlap` characters, and without the overlaps
    the pieces are the text. A text within the limit is one piece; null and empty texts give none; repeated rows give
    repeated pieces. Only the keys and the text leave the scan; nothing is shuffled.
    """
    picked = rows.select(*[c.alias(k) for k, c in keys.items()], (F.col(text) if isinstance(text, str) else text).alias("text"))
    more = [T.StructField("piece_no", T.IntegerType()), T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType()), T.StructField("mark_no", T.IntegerType()), T.StructField("piece", T.StringType())]
    schema = T.StructType([*[f for f in picked.schema if f.name != "text"], *more])
    return picked.mapInArrow(_Split(limit, overlap), schema)


def lacking_chunks(articles: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Live rows longer than the limit of whose lines at least one is in no live row that names them as its parent.

    Rows without content or id don't count, and null parents point nowhere. Lines are compared by sha256. The key of the comparison is row and line, so neither a row with very many chunks
    nor one with very many lines is ever gathered in one place.
    """
    live = articles.where(F.col("deleted_at").isNull())
    large = cut_lineage(live.where(F.length("content") > limit))  # few rows, used four times: else as many scans of all texts
    lines = lambda c: F.transform(F.split(c, "\n", -1), lambda x: F.sha2(x, 256))
    own = large.select("id", F.explode(F.array_distinct(lines("content"))).alias("line")).distinct()
    chunks = live.where(F.col("parent_article_pk").isNotNull()).select(F.col("parent_article_pk").alias("id"), "content")
    chunks = chunks.join(large.select("id").distinct(), "id", "left_semi")
    given = chunks.select("id", F.explode(F.array_distinct(lines("content"))).alias("line"))
    missing = own.join(given, ["id", "line"], "left_anti").select("id").distinct()
    return large.join(missing, "id", "left_semi")


def split_articles(articles: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all rows of the ledger that lack usable chunks, tied to their article.

    article_id is the row that was cut; parent_article_pk the whole article's (its own id if it is one); paragraph_no
    the chunk's own number or, in a whole article, that of the paragraph in which the piece begins (null before any).
    """
    articles = articles.select("id", "content", "parent_article_pk", "paragraph_no", "deleted_at")
    rows = lacking_chunks(articles, limit).withColumn("__text_hash", F.sha2("content", 256)).dropDuplicates(["id", "__text_hash"])
    keys = {"article_id": F.col("id"), "own_parent": F.col("parent_article_pk"), "own_paragraph": F.col("paragraph_no")}
    pieces = split_texts(rows, "content", keys, limit, overlap)
    whole = F.col("own_paragraph").isNull()
    return pieces.select(
        "article_id",
        F.when(whole, F.col("article_id")).otherwise(F.col("own_parent")).alias("parent_article_pk"),
        F.when(whole, F.col("mark_no")).otherwise(F.col("own_paragraph")).alias("paragraph_no"),
        "piece_no", "start_at", "end_at", "piece",
    )
