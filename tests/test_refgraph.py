import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexstrata.operators import checks, refgraph

ACT, DECREE, RULE = "700001", "700002", "700003"
LAWS = [(ACT, "하천법", "법률"), (DECREE, "하천법 시행령", "시행령"), (RULE, "하천법 시행규칙", "시행규칙"), (RULE, "하천법 시행규칙", "시행규칙")]


@pytest.fixture
def families(spark):
    return refgraph.law_families(spark.createDataFrame(LAWS, "law_id string, law_name string, hierarchy string"))


@pytest.mark.parametrize(
    "word, source, want",
    [("", RULE, RULE), (None, ACT, ACT), ("같은 법", RULE, RULE), ("이 영", DECREE, DECREE), ("법", RULE, ACT), ("시행령", ACT, DECREE), ("영", ACT, DECREE), ("시행규칙", DECREE, RULE), ("규칙", DECREE, RULE)]
    + [("하천법", RULE, ACT), ("하천법 시행규칙", ACT, RULE), ("하천법시행령", RULE, DECREE), ("댐건설법", ACT, None), ("조례", ACT, None)],
)
def test_qualifiers(spark, word, source, want):
    c = refgraph.resolve_qualifier(F.lit(word).cast("string"), F.lit(source), F.lit("하천법"), F.lit(ACT), F.lit(DECREE), F.lit(RULE))
    assert spark.range(1).select(c).first()[0] == want


def refs(spark, families, law, no, content):
    df = spark.createDataFrame([(1, law, no, content, "clash")], "id long, law_id string, article_no int, content string, base string").drop("base")
    return {(r.dst_law, r.dst_article): r.basis for r in refgraph.references(df, families).collect()}


def test_extraction(spark, families):
    """Own numbers count, other families' don't; headings and the article itself are left out; the first mention is the basis."""
    text = "[하천법 시행규칙 제12조(제방 점검)]\n관리청은 법 제31조의2와 영 제8조에 따라 제방을 살피고, 제40조 및 법 제31조의2를 따르되 제12조와 「댐건설법」 제77조는 보지 아니한다."
    got = refs(spark, families, RULE, 1200, text)
    assert got == {(ACT, 3102): "법 제31조의2", (DECREE, 800): "영 제8조", (RULE, 4000): "제40조"}
    assert set(refs(spark, families, ACT, 3102, "[하천법 제31조의2]\n이 법 제31조의2 및 시행규칙 제12조")) == {(RULE, 1200)}


@pytest.mark.parametrize(
    "body, want",
    [("그 공법 제3조", (ACT, 300)), ("수면에 관한 법률 제9조", (DECREE, 900)), ("시행령 제5조의2", (DECREE, 502)), ("하천법 시행규칙 제7조", (RULE, 700)), ("「하천법」 제8조", (ACT, 800)), ("같은 영 제4조", (DECREE, 400)), ("제１２조", (DECREE, 1200))],
)
def test_single_references(spark, families, body, want):
    assert set(refs(spark, families, DECREE, 100, f"[x]\n{body}")) == {want}


def test_no_text(spark, families):
    assert refs(spark, families, DECREE, 100, None) == refs(spark, families, DECREE, 100, "") == refs(spark, families, DECREE, 100, "[제3조]") == {}


def test_edges_and_expansion(spark, families):
    laws = spark.createDataFrame(LAWS, "law_id string, law_name string, hierarchy string")
    data = [
        (1, ACT, 100, None, "목적", "[h]\n제2조와 대통령령", True), (2, ACT, 200, None, None, "[h]\n영 제1조", True),
        (3, DECREE, 100, None, "t", "[h]\n법 제2조, 법 제1조의2, 법 제1조", True), (4, RULE, 100, None, "t", "[h]\n영 제1조 및 제9조", True), (5, ACT, 100, 1, "p", "제2조", True), (6, ACT, 200, None, "old", "제1조", False),
    ]
    articles = spark.createDataFrame(data, "id long, law_id string, article_no int, paragraph_no int, title string, content string, is_current boolean")
    nodes = refgraph.article_nodes(articles, laws)
    assert rows(nodes, "article_pk") == [(1,), (2,), (3,), (4,)]
    found = refgraph.node_references(articles, nodes, families)
    edges = refgraph.graph_edges(nodes, found, families)
    assert rows(edges, "src", "dst", "rel", "n") == [(1, 2, "CITES", 1), (1, 3, "DELEGATES", 1), (2, 3, "DELEGATES", 2), (3, 4, "DELEGATES", 1)]
    assert rows(refgraph.expand(spark.createDataFrame([(2,), (99,)], "article_pk long"), edges, nodes), "rel", "dst", "title") == [("DELEGATES", 3, "t")]
    stale = spark.createDataFrame([(8, 9, "CITES", "x", 1), (1, 2, "CITES", "old", 7)], "src long, dst long, rel string, basis string, n long")
    kept = refgraph.build(articles, laws, (nodes, stale), keep=True)
    assert rows(kept[1], "src", "dst", "rel", "n") == [*rows(edges, "src", "dst", "rel", "n"), (8, 9, "CITES", 1)] and rows(kept[0]) == rows(nodes)
    assert rows(refgraph.build(articles, laws, (nodes, stale), parts="nodes")[1]) == rows(stale)
    assert refgraph.build(articles, laws, parts="nodes")[1].count() == 0
    assert rows(refgraph.build(articles, laws, (nodes.limit(0), stale), parts="edges")[0]) == []
    with pytest.raises(ValueError):
        refgraph.build(articles, laws, parts="some")
    assert {r.n_bad for r in checks.graph_checks(edges, nodes, families).collect()} == {0}


def test_a_hop_from_every_article(spark):
    """The hop isn't run from one law's articles only: it follows every edge of the graph."""
    import os

    from conftest import DATA

    import __spark_entry__ as entry

    if not os.path.isdir(DATA):
        return
    hops = rows(entry.queries()["expand_one_hop_all"](spark, DATA), "article_pk", "rel", "dst")
    assert hops == rows(entry.queries()["citation_edges"](spark, DATA), "src", "rel", "dst") != []
