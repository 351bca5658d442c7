import json

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lexstrata.operators import chunking, variants

UNIT, HANG, HO, MOK = variants.LEVELS


def body(units):
    return {"법 령": {"기본정보": {"법령ID": "1", "법령명_한글": "나라법", "시행일자": "2024 0101", "공포일자": "x", "제개정구분": {"content": ""}, "소관부처": {"content": "부"}}, "조\n문": {"조문단위 ": units}}}


def brute(root):
    out = set()

    def go(value, level, at):
        items = [(1, value)] if isinstance(value, dict) else list(enumerate(value, 1)) if isinstance(value, list) else []
        for i, x in items:
            if isinstance(x, dict):
                here = (*at, i)
                out.add((level, here))
                clean = {variants.clean_key(k): v for k, v in x.items()}
                if level < 3:
                    go(clean.get(variants.LEVELS[level + 1]), level + 1, here)

    law = next(iter(root.values()))
    go(law["조\n문"]["조문단위 "], 0, ())
    return out


leaf = st.none() | st.just("") | st.text(max_size=3) | st.lists(st.text(max_size=2), max_size=2)


def level(i):
    text, no = variants.LEVEL_FIELDS[variants.LEVELS[i]]
    fields = {text: leaf, no: leaf}
    if i < 3:
        below = level(i + 1)
        fields[variants.LEVELS[i + 1] + " "] = st.none() | below | st.lists(below | st.none() | st.just("x"), max_size=3)
    return st.fixed_dictionaries({}, optional=fields)


@settings(max_examples=60, deadline=None)
@given(st.none() | level(0) | st.lists(level(0), max_size=3))
def test_walk_finds_every_object(units):
    root = body(units)
    got = [(lv, at) for lv, at, _ in variants.walk(json.dumps(root))]
    assert len(got) == len(set(got))
    assert set(got) == brute(root)


def test_states_are_canonical():
    a = variants.leave_object([("항 ", [variants.leave_object([("항내용", "x")])]), ("b", None)])
    b = variants.leave_object([("b", ""), ("항", [variants.leave_object([("항내용", "y"), ("호", [])])])])
    assert a.state == b.state


def test_odd_bodies(spark):
    texts = [None, "", "{", json.dumps(body([]))[:-3], "[]", "1", '{"법령": []}', '{"법령": {"조문": null}}', json.dumps(body({"조문내용": "가"})), "[" * 100_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "body_id long, body string, node_level string")
    assert rows(variants.nested_nodes(df, "body_id", "body"), "record_id", "node_level", "jo_pos", "hang_pos") == [(8, UNIT, 1, 0)]
    assert variants.nested_nodes(df.limit(0), "body_id", "body").count() == 0


def test_typed_tables_cover_all(spark, tmp_path):
    units = [
        {"조문여부": "전문", "조문내용": "제1장 총칙"},
        {"조문여부": "조문", "조문번호": "3", "조문가지번호": "2", "조문제목": "목적", "조문내용": ["제3조의2(목적)", "&lt;줄&gt;"], HANG: {"항내용": "① 하나", HO: [{"호내용": "1. 둘", MOK: {"목내용": "가. 셋"}}, None, {}]}},
    ]
    df = spark.createDataFrame([(1, json.dumps(body(units)))], "body_id long, body string")
    nodes = variants.nested_nodes(df, "body_id", "body")
    variants.write_typed(nodes, f"{tmp_path}/typed")
    tables = variants.typed_tables(spark, f"{tmp_path}/typed")
    assert sum(t.count() for n, t in tables.items() if "/" in n) == nodes.count() == 6
    ids = {r.node_id for r in nodes.collect()}
    assert {r.parent_id for r in nodes.collect() if r.parent_id} <= ids
    assert rows(tables[HO], "ho_pos", "subtype") == [(1, "item_text_one"), (3, "item_bare_leaf")]
    chunks = chunking.article_chunks(df).collect()
    assert [(c.article_no, c.content) for c in chunks] == [(302, "[나라법 제3조의2(목적)]\n제3조의2(목적)\n<줄>\n① 하나\n  1. 둘\n    가. 셋")]


def test_split_rule(spark):
    long = "가" * 3000
    units = [{"조문번호": "1", "조문제목": "t", "조문내용": "제1조", HANG: [{"항내용": long}, {}, {"항내용": long}]}, {"조문번호": "2", "조문내용": "나" * 7000}]
    df = spark.createDataFrame([(1, json.dumps(body(units)))], "body_id long, body string")
    got = {(c.article_no, c.paragraph_no, c.is_parent) for c in chunking.article_chunks(df).collect()}
    assert got == {(100, None, True), (100, 1, False), (100, 3, False), (200, None, False)}
    assert rows(chunking.body_meta(df))[0][1:] == ("1", "나라법", __import__("datetime").date(2024, 1, 1), None, "일부개정", "부")


DEPTH = 20_000


@pytest.mark.parametrize("deep", ["[" * DEPTH + "]" * DEPTH, "[" * DEPTH + '"x"' + "]" * DEPTH, '{"a":' * DEPTH + "1" + "}" * DEPTH, '{"content":' * DEPTH + '"x"' + "}" * DEPTH])
def test_deep_bodies(spark, deep):
    """However deep a field is, a complete body gives its nodes and facts; a torn one gives none."""
    whole = json.dumps(body([{"조문번호": "1", "조문내용": "DEEP"}, {"조문번호": "2", "조문내용": "나"}]), ensure_ascii=False).replace('"DEEP"', deep)
    df = spark.createDataFrame([(1, whole), (2, whole[:-1]), (3, whole + "]")], "body_id long, body string")
    got = rows(variants.nested_nodes(df, "body_id", "body"), "record_id", "jo_pos", "text")
    assert got == [(1, 1, "x" if "x" in deep else None), (1, 2, "나")]
    assert [r.body_id for r in chunking.body_meta(df).collect()] == [1]


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(values, st.integers(0, 3), st.integers(0, 400))
def test_both_parsers_alike(value, indent, cut):
    for text in (t := json.dumps(value, indent=indent or None), t[:cut]):
        results = []
        for parse in (lambda x: json.loads(x, object_pairs_hook=variants.leave_object), variants._load_deep):
            try:
                results.append(repr(parse(text)))
            except ValueError:
                results.append("torn")
        assert results[0] == results[1]
