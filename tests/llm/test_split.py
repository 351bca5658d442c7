import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.llm import split

alphabet = st.text(alphabet="가나다. \n①②1.2éᅡa", max_size=400)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-1, 6), min_size=1, max_size=60))
def test_range_maximum(values):
    index = split.RangeMaximum(np.array(values, np.int8))
    for lo in range(len(values)):
        for hi in range(lo, len(values)):
            part = values[lo : hi + 1]
            assert index.query(lo, hi) == lo + max(i for i, v in enumerate(part) if v == max(part))


@settings(max_examples=150, deadline=None)
@given(alphabet, st.integers(10, 60), st.data())
def test_pieces(text, limit, data):
    overlap = data.draw(st.integers(0, limit // 2 - 1))
    cuts = split.cut_points(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in cuts)
    assert all(a2 == b1 - overlap for (_, b1), (a2, _) in zip(cuts, cuts[1:]))
    assert "".join(text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(cuts)) == text
    strengths = split.boundary_strengths(text)
    least = max(overlap, limit // 2)
    for a, b in cuts[:-1]:
        window = strengths[a + least + 1 : a + limit + 1]
        assert strengths[b] == window.max()
        assert not (strengths[b + 1 : a + limit + 1] == window.max()).any()


def test_blocks_do_not_matter(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["가나", ". ", "\n", "\n① ", " ", "말"]) for _ in range(20_000))
    whole = split.cut_points(text, 300, 40)
    monkeypatch.setattr(split, "BLOCK", 700)
    assert split.cut_points(text, 300, 40) == whole


def test_natural_boundaries():
    text = "가" * 30 + ". " + "나" * 30 + "\n1. " + "다" * 20 + "\n② " + "라" * 30
    (a, b), *_ = split.cut_points(text, 90, 10)
    assert text[b:].startswith("② ")
    with pytest.raises(ValueError):
        split.cut_points("x" * 50, 20, 10)


SCHEMA = "id long, law_id string, content string, content_hash string, parent_article_pk long, paragraph_no int, deleted_at timestamp_ntz, piece string, line string, __text string"


def ledger(spark, data):
    return spark.createDataFrame([(i, "1", c, "h", p, n, None, "x", "y", "z") for i, c, p, n in data], SCHEMA)


def test_lacking_chunks(spark):
    long = "\n".join(f"① {'가' * 60} {i}" for i in range(20))
    lines = long.split("\n")
    data = [
        (1, long, None, None),  # all its lines are in chunks
        (2, "\n".join(lines[:12]), 1, 1), (3, "\n".join(lines[12:]), 1, 2),
        (4, long + "\n", None, None), (5, long, 4, 1),  # an empty line is missing
        (6, long, None, None), (7, "\n".join(lines[1:]), 6, 1),  # a line is missing
        (8, long, 99, 3), (8, long, 99, 3),  # an oversized chunk, delivered twice
        (9, None, None, None), (10, "", 8, None), (None, long, None, None),
    ]
    got = split.split_articles(ledger(spark, data), 500, 50)
    # the chunks are above this limit themselves and nobody names them as parents
    assert rows(got.select("article_id").distinct()) == [(2,), (3,), (4,), (5,), (6,), (7,), (8,)]
    eight = got.where("article_id = 8").orderBy("piece_no").collect()
    assert [r.piece_no for r in eight] == list(range(1, len(eight) + 1))
    assert {(r.parent_article_pk, r.paragraph_no) for r in eight} == {(99, 3)}
    assert {r.parent_article_pk for r in got.where("article_id = 6").collect()} == {6}
    assert all(r.end_at - r.start_at + 1 == len(r.piece) <= 500 for r in got.collect())
    assert split.split_articles(ledger(spark, [])).count() == 0


def test_null_empty_long(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "글" * 1_000_000)], "id long, text string")
    got = split.split_texts(df, "text", {"id": F.col("id")}, 6000, 200).groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("piece")).alias("m"))
    assert rows(got) == [(3, 1, 5), (4, 173, 6000)]
