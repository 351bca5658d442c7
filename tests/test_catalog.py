import pytest
from conftest import rows

from lexstrata.operators import catalog, checks, requirements

ITEM = "array<struct<dcerCfrmLworCd string, dcerCfrmLworNm string, reqApreIttCd string, reqApreIttNm string, reqCfrmIstmNm string, aplyStrtDt string, bfhnAffcRtmTpcd string>>"


def item(law="A", law_name="법가", agency="G1", agency_name="기관", doc="서식", start="20200101"):
    return (law, law_name, agency, agency_name, doc, start, None)


def progress(spark, *data):
    import datetime as dt

    return spark.createDataFrame([(i, hs, t, items, dt.datetime(2024, 1, 1)) for i, (hs, t, items) in enumerate(data)], f"rec_no long, hs string, tpcd string, items {ITEM}, swept_at timestamp_ntz")


@pytest.fixture
def nodes(spark):
    data = [("85", "장", None, False), ("8542", "호", None, False), ("854231", "소호", None, False), ("8542310000", "칩", "chip", True), ("8542320000", "메모리", None, True)]
    return spark.createDataFrame(data, "code string, name_ko string, name_en string, is_leaf boolean")


def test_sheets_and_checks(spark):
    a, b = spark.createDataFrame([("01", "가", None)], "x string, y string, z string"), spark.createDataFrame([("010", "나", "n"), ("01", "다", None)], "c string, k string, e string")
    sheet = catalog.union_sheets([a, b])
    assert rows(catalog.bad_codes(sheet)) == [("01", "duplicate"), ("010", "level")]
    with pytest.raises(ValueError):
        catalog.union_sheets([a.drop("z")])


def test_hierarchy(spark, nodes):
    assert rows(catalog.with_ancestors(nodes), "code", "hs6_name", "heading4_name", "chapter2_name") == [("8542310000", "소호", "호", "장"), ("8542320000", None, "호", "장")]
    new = nodes.where("code <> '85'").replace("칩", "새칩").union(spark.createDataFrame([("99", None, None, False)], nodes.schema))
    assert rows(catalog.catalog_diff(nodes, new), "code", "change") == [("85", "removed"), ("8542310000", "renamed"), ("99", "added")]
    assert rows(catalog.upsert_nodes(nodes, new.where("code = '8542310000'")).where("is_leaf"), "name_ko") == [("메모리",), ("새칩",)]
    attributes = spark.createDataFrame([("8542310000", "KG")], "code string, unit string")
    assert rows(catalog.leaf_attributes(nodes, attributes), "code", "unit", "has_attributes")[-1:] == [("8542320000", None, False)]
    assert {r.check_name: r.n_bad for r in checks.catalog_checks(catalog.prefix_columns(nodes)).collect()} == {"code_length": 0, "code_twice": 0, "leaf_flag": 0, "prefix_differs": 0}


def test_requirements(spark, nodes):
    log = progress(
        spark,
        ("8542310000", "1", [item(), item(doc="나중"), None]), ("8542-31.0000", "2 ", [item("B", "법나", start="")]), ("85", "1", [item("C", "", "G2", "")]), ("8542", "1", [item("A", "법가2", "G2", "기관2", "상속", "20990101")]),
        ("0000000000", "1", [item("Z")]), ("8542310000", "1", None), ("8542310000", "1", []),
    )
    items = requirements.known_products(requirements.sweep_items(log), nodes)
    edges = requirements.requires_edges(items)
    assert rows(edges, "hs", "law_code", "trade_type", "document") == [("85", "C", "수출", "서식"), ("8542", "A", "수출", "상속"), ("8542310000", "A", "수출", "나중"), ("8542310000", "B", "수입", "서식")]
    laws = requirements.first_names(items, "law_code", "law_name")
    assert rows(laws) == [("A", "법가"), ("B", "법나"), ("C", "")]
    paths = requirements.traverse(edges, laws, requirements.approvals(items), requirements.first_names(items, "agency_code", "agency_name"))
    assert {(r.law_code, tuple(r.agencies)) for r in paths.collect()} == {("A", ("", "기관")), ("B", ("기관",))}
    asked = spark.createDataFrame([("8542310000",), ("0101",)], "code string")
    found = requirements.lookup(asked, paths)
    assert rows(found, "law_code", "source", "level") == [("A", "direct", 10), ("A", "inherited", 4), ("B", "direct", 10)]
    assert rows(requirements.lookup(asked, paths, "수입", "20200101"), "law_code") == [("B",)]
    assert requirements.lookup(asked, paths, as_of="20240101").count() == 2
    got = {r.hsk10: r for r in requirements.lookup_response(asked, nodes, found).collect()}
    assert got["8542310000"].name_en == "chip" and got["8542310000"].ancestors.hs6.name == "소호" and got["8542310000"].subject
    assert got["0101000000"].requirements == [] and not got["0101000000"].subject
    assert rows(requirements.sweep_todo(nodes.where("is_leaf"), log), "hs", "tpcd") == [("8542320000", "1"), ("8542320000", "2")]
    assert requirements.sweep_todo(nodes.where("is_leaf"), log, 1).count() == 1
    assert sum(r.n_bad for r in checks.requirement_checks(edges, requirements.approvals(items)).collect()) == 0


def test_unknown_direction_raises(spark):
    with pytest.raises(Exception, match="direction"):
        requirements.sweep_items(progress(spark, ("1", "3", [item()]))).collect()
