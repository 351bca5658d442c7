import unicodedata

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexstrata.llm import normalize

SAME = [
    ("ＡＢＣ１２３（가）", "ABC123(가)"),
    ("가각힣", unicodedata.normalize("NFD", "가각힣")),
    ("café", "café"),
    ("관​세­법﻿", "관세법"),
    ("관세 법　령", "관세 법 령"),
    ("АВС", "ABC"),
    ("ΑΒΕ", "ABE"),
    ("수출ㆍ수입", "수출·수입"),
    ("a‐b−c", "a-b-c"),
    ("1～2∼3", "1~2~3"),
    ("車", "車"),
    ("｢법｣", "「법」"),
    ("ﾊﾟ", "パ"),
    ("ѐ", "è"),
    ("ѐ", "è"),
    ("⼀", "一"),
]
OTHER = [("m2", "m²"), ("m²", "㎡"), ("m2", "㎡"), ("①", "1"), ("a b", "a  b"), ("A", "a"), ("車", "更"), ("가", "나"), ("℃", "°C"), ("½", "1/2"), ("Ⅳ", "IV")]


def forms(texts):
    con = duckdb.connect()
    return [con.execute(f"SELECT {normalize.form_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchall()[0][0] for t in texts]


@pytest.mark.parametrize("a, b", SAME)
def test_alike(a, b):
    x, y = forms([a, b])
    assert x == y == normalize.form_of(a) == normalize.form_of(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_different(a, b):
    x, y = forms([a, b])
    assert x != y


def test_form_is_stable_and_python_agrees():
    chars = [chr(p) for p in range(1, 0x30000) if not 0xD800 <= p <= 0xDFFF and unicodedata.category(chr(p)) != "Cn"]
    made = forms(["a".join(chars[i : i + 500]) for i in range(0, len(chars), 500)])
    again = forms(made)
    assert made == again
    python = [normalize.form_of("a".join(chars[i : i + 500])) for i in range(0, len(chars), 500)]
    assert sum(a != b for a, b in zip(made, python)) <= 2  # characters newer than one of the two databases


def test_normalize_text(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "ＡＢ", "z"), (4, "가​" * 200_000, "w")], "id long, t string, form string")
    got = normalize.normalize_text(df, {"t": "n"})
    assert rows(got.where("id < 4"), "id", "form", "n") == [(1, "x", None), (2, "y", ""), (3, "z", "AB")]
    assert got.where("id = 4").select(F.length("n")).first()[0] == 200_000
    assert rows(normalize.normalize_text(df.limit(0), {"t": "n"})) == []
    with pytest.raises(ValueError):
        normalize.normalize_text(df, {"t": "form"})


def test_pairs_and_members(spark):
    data = [(1, "g", "ＡＢ"), (2, "g", "AB"), (3, "g", "AB"), (3, "g", "AB"), (4, "g", "AC"), (5, "h", "ＡＢ"), (6, "g", None), (None, "g", "ＡＢ"), (7, None, "A​B"), (8, None, "AB"), (9, "g", "A​B")]
    df = spark.createDataFrame([(*r, "clash") for r in data], "id long, g string, t string, k string")
    got = normalize.look_alike_classes(df, F.coalesce("g", F.lit("-")), "id", "t")
    assert rows(normalize.look_alike_pairs(got)) == [(1, 2), (1, 3), (1, 9), (2, 9), (3, 9), (7, 8)]
    assert rows(normalize.look_alike_members(got)) == [(1, 1, 3), (2, 2, 2), (3, 2, 2), (7, 7, 1), (8, 8, 1), (9, 9, 3)]
    none = normalize.look_alike_classes(df.limit(0), F.col("g"), "id", "t")
    assert rows(normalize.look_alike_pairs(none)) == rows(normalize.look_alike_members(none)) == []


def test_many_copies_of_two_forms(spark):
    """Members are as many as the rows, however many look alike."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "ＡＢ").otherwise("AB").alias("t"))
    got = normalize.look_alike_members(normalize.look_alike_classes(df, F.lit("g"), "id", "t"))
    assert rows(got.groupBy("class_id", "n_links").count()) == [(0, 10_000, 10_000), (1, 10_000, 10_000)]
