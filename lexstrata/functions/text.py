"""Scalar text functions as Column expressions; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits of full width and their ASCII forms.
WIDE_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_any(c: Column | str) -> Column:
    """Without white space of any kind (Unicode) at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def digits_of(c: Column | str) -> Column:
    """The decimal digits in order, full-width ones as ASCII; null when there are none."""
    return F.nullif(F.regexp_replace(F.translate(_col(c), WIDE_DIGITS, ASCII_DIGITS), "[^0-9]", ""), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """Null, empty or nothing but white space."""
    return _col(c).isNull() | (trim_any(c) == "")


def squash(c: Column | str) -> Column:
    """Without any Unicode white space; null becomes ''."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", "")


@F.pandas_udf(T.StringType())
def unescape(texts):  # noqa: ANN001, ANN201
    """HTML entities resolved; the one text step that SQL lacks."""
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def clean_text(c: Column | str) -> Column:
    """Entities resolved, no-break spaces plain, blanks before line ends and outer white space cut; null becomes ''."""
    text = F.replace(unescape(F.coalesce(_col(c), F.lit(""))), F.lit(" "), F.lit(" "))
    return trim_any(F.regexp_replace(text, r"[ \t]+\n", "\n"))


def article_code(no: Column | str, branch: Column | str) -> Column:
    """number * 100 + branch; a missing branch is 0; null if the number isn't one; branches from 100 on raise."""
    ascii_digits = lambda c: F.translate(_col(c).cast("string"), WIDE_DIGITS, ASCII_DIGITS)
    number = trim_any(ascii_digits(no)).try_cast("int")
    part = F.coalesce(trim_any(ascii_digits(branch)).try_cast("int"), F.lit(0))
    return F.when(part < 100, number * 100 + part).otherwise(F.raise_error(F.lit("an article's branch must be below 100")))


def article_label(no: Column | str, branch: Column | str) -> Column:
    """제N조 or 제N조의M; leading zeros go only from all-digit numbers; branches null, '', 0 and 00 don't show."""
    bare = lambda c: F.when(c.rlike(r"^\d+$"), F.regexp_replace(c, r"^0+(?=\d)", "")).otherwise(c)
    number, part = _col(no).cast("string"), _col(branch).cast("string")
    head = F.concat(F.lit("제"), bare(number), F.lit("조"))
    return F.when(part.isNull() | part.isin("", "0", "00"), head).otherwise(F.concat(head, F.lit("의"), bare(part)))


def code_label(code: Column | str) -> Column:
    """The label of an article code (number * 100 + branch)."""
    c = _col(code)
    head = F.concat(F.lit("제"), F.floor(c / 100).cast("string"), F.lit("조"))
    return F.when(c % 100 == 0, head).otherwise(F.concat(head, F.lit("의"), (c % 100).cast("string")))


def parse_article(c: Column | str) -> Column:
    """'226' to 22600, '5의2' to 502; null for anything else."""
    part = lambda i: F.regexp_extract(_col(c), r"^\s*(\d+)(?:의(\d+))?\s*$", i)
    return F.when(part(1) != "", part(1).try_cast("int") * 100 + F.coalesce(part(2).try_cast("int"), F.lit(0)))


# Short names of the three levels of a law family.
SHORT_NAMES = {"법": "act", "영": "decree", "시행령": "decree", "규칙": "rule", "시행규칙": "rule"}


def hierarchy_of(name: Column | str) -> Column:
    """시행령 or 시행규칙 by the name's end, else 법률."""
    n = _col(name)
    return F.when(n.endswith("시행령"), "시행령").when(n.endswith("시행규칙"), "시행규칙").otherwise("법률")


def strict_date(c: Column | str) -> Column:
    """yyyyMMdd as a date; anything else raises under ANSI mode, null stays null."""
    return F.to_date(_col(c), "yyyyMMdd")


def lenient_date(c: Column | str) -> Column:
    """yyyyMMdd as a date, null for anything else."""
    return F.try_to_date(_col(c), "yyyyMMdd")


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """The RFC 4122 version 5 id of a name, in SQL: SHA-1 over the namespace's bytes and the name's, version and variant set."""
    import uuid

    space = uuid.UUID(namespace).hex
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


POINT_NAMESPACE = "a3f0b6de-6d0e-5b5c-9f55-0c1c1f3f7f10"


def point_id(law_id: Column, article_no: Column, paragraph_no: Column, mst: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """The stable id of a version in an index; the namespace is a parameter so that ids of an existing index can be kept."""
    parts = [law_id, article_no.cast("string"), F.coalesce(paragraph_no, F.lit(0)).cast("string"), mst]
    return uuid5(namespace, F.concat_ws(":", *parts))


def heading(law_name: Column, label: Column, title: Column) -> Column:
    """[law label(title)], without the brackets where there's no title."""
    return F.concat(F.lit("["), law_name, F.lit(" "), label, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("("), title, F.lit(")"))).otherwise(""), F.lit("]"))


def normalize_code(c: Column | str) -> Column:
    """A product code as ten digits: others dropped, cut or filled with zeros on the right; null becomes ten zeros."""
    digits = F.regexp_replace(F.translate(F.coalesce(_col(c), F.lit("")), WIDE_DIGITS, ASCII_DIGITS), "[^0-9]", "")
    return F.rpad(digits, 10, "0")


# Lengths of a code's ancestors.
PREFIXES = {"hs6": 6, "heading4": 4, "chapter2": 2}


def first_line(c: Column | str) -> Column:
    """Up to the first line end of any kind, trimmed."""
    return trim_any(F.regexp_extract(_col(c), "^[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]*", 0))


def shortened(c: Column | str, width: int = 72) -> Column:
    """Cut to the width, the last place an ellipsis."""
    t = _col(c)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 1), F.lit("…"))).otherwise(t)


def without_heading(c: Column | str) -> Column:
    """A chunk's text without its heading line ('' if there's nothing else)."""
    t = _col(c)
    rest = F.when(F.locate("\n", t) > 0, F.substring(t, F.locate("\n", t) + 1, F.length(t))).otherwise("")
    return F.when(t.startswith("["), rest).otherwise(t)
