import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lexstrata.llm import contamination
from lexstrata.llm.normalize import form_of


def folded(text):
    return "".join(c for c in form_of(text).lower() if c.isalnum())


def brute(docs, items, limit):
    out = set()
    for d, text in docs:
        for i, item in items:
            if any(item[k : k + limit] in text for k in range(len(item) - limit + 1)):
                out.add((d, i))
    return out


words = st.text(alphabet="abc", max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), st.lists(words, max_size=5), st.integers(1, 8))
def test_automaton_against_brute_force(items, docs, limit):
    items = list(enumerate(items))
    automaton = contamination.ItemAutomaton(items, limit)
    docs = [(i, d) for i, d in enumerate(docs + [t[2:] + "c" + t[:9] for _, t in items])]
    assert {(d, i) for d, t in docs for i in automaton.spans(t)[1]} == brute(docs, items, limit)


@settings(max_examples=100, deadline=None)
@given(words, words, st.integers(2, 8))
def test_longest_matches(item, doc, limit):
    automaton = contamination.ItemAutomaton([(1, item)], limit)
    got = {end: size for end, size, _ in automaton.matches(doc)}
    for end in range(1, len(doc) + 1):
        longest = max((n for n in range(end + 1) if doc[end - n : end] in item), default=0)
        assert got.get(end, 0) == (longest if longest >= limit else 0)


def text(rnd, n):
    return "".join(rnd.choice("가나다라마바사아자차카타파하abcdefg123") for _ in range(n))


@pytest.mark.parametrize("block", [contamination.BLOCK_CHARS, 300])
def test_documents(spark, block):
    rnd = random.Random(8)
    items = [(i, text(rnd, rnd.choice([30, 80, 150]))) for i in range(12)] + [(99, None), (None, "x" * 80), (3, text(rnd, 90))]
    docs = []
    for i in range(200):
        t = text(rnd, rnd.randrange(0, 400))
        if i % 4 == 0:
            src = rnd.choice([t2 for j, t2 in items if j is not None and t2])
            cut = src[rnd.randrange(0, 20) :][: rnd.choice([48, 49, 50, 51, 90])]
            t = t[:50] + " ".join(cut) + "​, " + t[50:]
        docs.append((i, t))
    docs += [(200, None), (201, ""), (None, items[1][1]), docs[4]]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, folded string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.leaked_items(d, i, block_chars=block)
    expected = brute([(k, folded(t)) for k, t in docs if k is not None and t is not None], [(k, folded(t)) for k, t in items if k is not None and t], 50)
    assert {tuple(r) for r in got.collect()} == expected != set()
    assert rows(contamination.leaked_items(d.limit(0), i)) == rows(contamination.leaked_items(d, i.limit(0))) == []


def test_cleaned(spark):
    rnd = random.Random(1)
    item = text(rnd, 120)
    before, after = text(rnd, 300), text(rnd, 300)
    spaced = "ＡＢ " + " ".join(item[10:80]) + "."
    docs = spark.createDataFrame([(1, before + spaced + after), (2, item + "!"), (3, before)], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination.leaking_documents(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2}
    assert got[1].cleaned == before + "ＡＢ ." + after
    (cut,) = got[1]["cut"]
    assert (before + spaced + after)[cut.start_at - 1 : cut.end_at] == " ".join(item[10:80])
    assert got[2].cleaned is None and got[2]["items"] == [7]


def test_cleaned_alike_whatever_the_blocks(spark):
    """A document that leaks items of several automata gets one row (a repeated one as many as it stands), all spans cut and their sum tested."""
    rnd = random.Random(5)
    items = [(i, text(rnd, 100)) for i in range(8)]
    own = [text(rnd, 150) for _ in range(4)]
    both = own[0] + items[0][1] + own[1] + items[5][1] + own[2]
    docs = [(1, both), (2, own[0] + items[1][1] + items[2][1][:90] + own[1]), (3, both), (3, both), (4, own[3])]
    docs += [(5, text(rnd, 160) + "".join(t[:80] for _, t in items[:3])), (6, items[6][1] + own[3]), (7, own[3] + "".join(t for _, t in items))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (rows(contamination.leaking_documents(d, i, block_chars=n)) for n in (contamination.BLOCK_CHARS, 150))
    assert one == many
    got = {r[0]: r for r in many}
    assert [r[0] for r in many] == [1, 2, 3, 3, 5, 6, 7]
    assert got[1][1] == [0, 5] and got[1][3] == "".join(own[:3]) and got[1][4] == "cut"
    assert got[5][3] is None and got[5][4] == "covered"  # 240 of 400, at most 80 of one item


def test_unplaced():
    """A document whose places can't be told isn't taken for one that is covered."""
    spans = [(0, 50)]
    assert contamination.without_spans("a" * 200, 200, spans, 0.5)[2] == "cut"
    assert contamination.without_spans("a" * 200, 199, spans, 0.5) == (None, None, "unplaced")
    assert contamination.without_spans("a" * 200, 200, [(0, 150)], 0.5)[2] == "covered"


def test_many_automata_read_the_corpus_as_often_as_two(spark, tmp_path):
    """The number of items multiplies neither scans nor branches; what one block would find is found, also by hot items and repeated documents."""
    rnd = random.Random(6)
    items = [(i, text(rnd, 70)) for i in range(1000)]
    docs = [(d, text(rnd, 60) + (items[0][1] if d % 3 == 0 else items[rnd.randrange(1000)][1][: rnd.choice([49, 50, 70])])) for d in range(600)] + [(3, text(rnd, 9) + items[5][1])] * 40
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    d, i = spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame(items, "item_id long, text string")
    got = contamination.leaked_items(d, i, block_chars=2_000)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert {tuple(r) for r in got.collect()} == brute([(k, folded(t)) for k, t in docs], [(k, folded(t)) for k, t in items], 50)
    one, many = (rows(contamination.leaking_documents(d, i, block_chars=n)) for n in (contamination.BLOCK_CHARS, 2_000))
    assert one == many
