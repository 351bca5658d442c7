import hashlib
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexstrata.functions import lexical, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("code, want", [("0101 21 0000", "0101210000"), ("8542", "8542000000"), ("123456789012345", "1234567890"), ("0204100000", "0204100000"), (None, "0000000000"), ("８５42", "8542000000")])
def test_normalize_code(spark, code, want):
    assert one(spark, text.normalize_code("c"), c=code) == want


@pytest.mark.parametrize("no, branch, code, label", [("226", "", 22600, "제226조"), ("5", "2", 502, "제5조의2"), ("007", "00", 700, "제7조"), ("7", "000", 700, "제7조의0"), ("１２", None, 1200, "제12조"), ("x", None, None, None)])
def test_article_numbers(spark, no, branch, code, label):
    assert one(spark, text.article_code("n", "b"), n=no, b=branch) == code
    if no.isascii() and no.isdigit():
        assert one(spark, text.article_label("n", "b"), n=no, b=branch) == label


def test_branch_overflow_raises(spark):
    with pytest.raises(Exception, match="below 100"):
        one(spark, text.article_code("n", "b"), n="1", b="100")


@pytest.mark.parametrize("given, want", [("226", 22600), ("5의2", 502), (" 7 ", 700), ("abc", None), ("", None), (None, None)])
def test_parse_article(spark, given, want):
    assert one(spark, text.parse_article("c"), c=given) == want


@pytest.mark.parametrize("given, want", [(" a  b\n", "ab"), (None, ""), ("", "")])
def test_squash(spark, given, want):
    assert one(spark, text.squash("c"), c=given) == want


def test_clean_text(spark):
    assert one(spark, text.clean_text("c"), c="　&lt;가&gt;&nbsp;나 \t\n다 ") == "<가> 나\n다"
    assert one(spark, text.clean_text("c"), c=None) == ""


def test_hash_and_ids(spark):
    assert one(spark, text.content_hash("c"), c="가") == hashlib.sha256("가".encode()).hexdigest()
    for para in (None, 3):
        got = one(spark, text.point_id(F.lit("001"), F.lit(100), F.lit(para).cast("int"), F.lit("9")))
        assert got == str(uuid.uuid5(uuid.UUID(text.POINT_NAMESPACE), f"001:100:{para or 0}:9"))


def test_small_ones(spark):
    assert one(spark, text.hierarchy_of("c"), c="나라법 시행령") == "시행령"
    assert one(spark, text.hierarchy_of("c"), c="나라법 시행규칙") == "시행규칙"
    assert one(spark, text.hierarchy_of("c"), c="나라법") == "법률"
    assert one(spark, text.first_line("c"), c="  a b\x0bc") == "a b"
    assert one(spark, text.shortened("c", 5), c="abcdef") == "abcd…"
    assert one(spark, text.without_heading("c"), c="[h]\na\nb") == "a\nb"
    assert one(spark, text.without_heading("c"), c="[h]") == ""
    assert one(spark, text.without_heading("c"), c="a\nb") == "a\nb"
    assert one(spark, text.trim_any("c"), c="  a　") == "a"
    assert one(spark, text.lenient_date("c"), c="2024-01") is None
    with pytest.raises(Exception):
        one(spark, text.strict_date("c"), c="2024013")
    assert one(spark, text.code_label(F.lit(502))) == "제5조의2"
    assert one(spark, text.heading(F.lit("법"), F.lit("제1조"), F.lit(None).cast("string"))) == "[법 제1조]"


def model(t):
    import re

    out = []
    for run in re.findall("[가-힣]+|[a-z0-9]+", (t or "").lower()):
        out.append(run)
        if "가" <= run[0]:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


TEXTS = ["하천", "물", "하천 abc 물 하천부", "", "...", None, "하천부지의 점용", "ABC123가나다", "하천 하천"]


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", lexical.tokens(F.col("t")).alias("k")).collect()}
    assert got == {i: model(t) for i, t in enumerate(TEXTS)}
    assert got[0] == ["하천", "하천"]
    assert all(sorted(lexical.token_counts(t)[0].elements()) == sorted(model(t)) and lexical.token_counts(t)[1] == len(model(t)) for t in TEXTS)
    assert all(set(lexical.query_terms(t)) == set(model(t)) for t in TEXTS)


def test_token_id_and_weights(spark):
    want = int.from_bytes(hashlib.md5("하천".encode()).digest()[:4], "little")
    assert one(spark, lexical.token_id(F.lit("하천"))) == want
    few, many = (one(spark, lexical.tf_weight(F.lit(n), F.lit(n))) for n in (2, 10))
    assert few < many < lexical.K1 + 1
    assert rows(spark.range(1).select(F.round(lexical.idf(F.lit(10), F.lit(1)), 4))) == [(1.9924,)]
