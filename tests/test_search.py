import datetime as dt
import math
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexstrata.functions import lexical
from lexstrata.operators import search

SCHEMA = "id long, law_id string, article_no int, paragraph_no int, content string, valid_from date, valid_to date, is_current boolean"
D = dt.date


@pytest.fixture
def articles(spark):
    data = [
        (1, "L", 100, None, "수입물품의 통관", D(2024, 1, 1), None, True), (2, "L", 100, None, "옛 통관", D(2020, 1, 1), D(2024, 1, 1), False),
        (3, "L", 200, None, "수출 신고", D(2020, 1, 1), None, True), (4, "L", 300, 1, "통관 통관 신고", D(2024, 1, 1), None, True), (5, "L", 400, None, None, D(2020, 1, 1), None, True),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_keyword_arm(articles):
    got = search.search(articles, "통관 물품", "bm25", 10).collect()
    assert [r.article_pk for r in got] == [1, 4]
    assert search.search(articles, "없는말", "bm25", 10).count() == 0
    assert search.search(articles, "", "bm25", 10).count() == 0
    posted = search.postings(articles.where("is_current"), "id", "content")
    by_table = search.bm25_search(posted, articles.where("is_current").agg(F.count(F.lit(1))), "통관 물품", 10)
    assert [(r.doc_id, round(r.score, 9)) for r in by_table.collect()] == [(r.article_pk, round(r.score, 9)) for r in got]


def test_as_of(articles):
    got = search.search(articles, "통관", "bm25", 10, as_of=F.lit(D(2022, 1, 1))).collect()
    assert [(r.article_pk, r.text) for r in got] == [(2, "옛 통관")]  # article 300 has no version that day and isn't refilled


def test_dense_arm(spark, articles):
    with pytest.raises(ValueError):
        search.search(articles, "x", "other")
    with pytest.raises(ValueError):
        search.search(articles, "x", "dense")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    got = search.search(articles, "x", "dense", 5, vectors=vectors, query_vector=[2.0, 0.0])
    assert [(r.article_pk, round(r.score, 6)) for r in got.collect()] == [(1, 1.0), (3, 0.707107)]
    both = search.two_arms(got, search.search(articles, "통관", "bm25", 5))
    assert {r.arm for r in both.collect()} == {"dense", "bm25"}
    assert rows(search.api_hits(got, 1), "score", "head") == [(1.0, "수입물품의 통관")]


def best(pairs, limit):
    """(query, doc, score) of the first `limit` of each query."""
    out = []
    for q in {q for q, _, _ in pairs}:
        out += sorted((p for p in pairs if p[0] == q), key=lambda p: (-round(p[2], 9), p[1]))[:limit]
    return sorted((q, d, round(s, 6)) for q, d, s in out)


def got(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("block", [2, 2_000])
def test_tables_of_queries(spark, monkeypatch, block):
    """Every query is answered, over all rows, however queries are cut into blocks; one query's answer is that of the single search."""
    monkeypatch.setattr(search, "BLOCK_QUERIES", block)
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choices(["통관", "수입물품", "관세", "신고", "abc", "세율표", "12"], k=rnd.randrange(0, 9)))) for i in range(0, 900, 3)] + [(901, None), (1000, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    by_words = got(search.bm25_search_all(docs, "doc_id", "text", asked, 7))
    counted = {i: lexical.token_counts(t) for i, t in texts}
    df = Counter(t for c, _ in counted.values() for t in c)
    weight = lambda n, size: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / 256))
    idf = lambda t: math.log((len(texts) - df[t] + 0.5) / (df[t] + 0.5) + 1)
    pairs = [(q, d, sum(weight(c[t], size) * idf(t) for t in counted[q][0] if t in c)) for q in counted if q % 100 == 0 for d, (c, size) in counted.items() if counted[q][0].keys() & c.keys()]
    assert by_words == best(pairs, 7) and len({q for q, _, _ in by_words}) > 1
    one = by_words[0][0]
    alone = search.bm25_scan(docs, "doc_id", "text", dict(texts)[one], 1000).collect()
    assert {x[1:] for x in by_words if x[0] == one} <= {(r.doc_id, round(r.score, 6)) for r in alone}

    data = [(i, [rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(400)] + [(500, None), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 1.0]), (800, [1.0, 2.0]), (801, [2.0, 1.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    fit = {i: v for i, v in data if v and None not in v and any(v)}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    pairs = [(q, d, sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b)) for q, a in fit.items() if q % 100 == 0 for d, b in fit.items() if len(a) == len(b)]
    assert got(search.dense_search_all(vectors, "vec_id", "embedding", asked, 7)) == best(pairs, 7)
    nothing = asked.limit(0)
    assert search.dense_search_all(vectors, "vec_id", "embedding", nothing, 7).count() == 0
    assert search.bm25_search_all(docs, "doc_id", "text", docs.limit(0).select(F.col("doc_id").alias("query_id"), "text"), 7).count() == 0


def test_encoder(spark):
    df = spark.createDataFrame([("관세 통관",), ("",), (None,)], "t string")
    got = [r.embedding for r in search.hashed_encoder(df, "t").collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and set(got[1]) == set(got[2]) == {0.0}
