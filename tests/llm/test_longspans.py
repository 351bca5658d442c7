import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lexstrata.llm import longspans

LEAST = longspans.LEAST


def brute(docs):
    seen = {}
    for d, t in docs:
        if d is not None and t is not None:
            for i in range(len(t) - LEAST + 1):
                seen.setdefault(t[i : i + LEAST], set()).add(d)
    marks = {}
    for d, t in docs:
        if d is not None and t is not None:
            flags = marks.setdefault((d, t), [False] * len(t))
            for i in range(len(t) - LEAST + 1):
                if len(seen[t[i : i + LEAST]]) > 1:
                    flags[i : i + LEAST] = [True] * LEAST
    out = set()
    for (d, _), flags in marks.items():
        i = 0
        while i < len(flags):
            j = i
            while j < len(flags) and flags[j]:
                j += 1
            if j > i:
                out.add((d, i + 1, j - i))
            i = j + 1
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("가나다라마바사 abcde.\n1") for _ in range(k))
    passages = [word(rnd.choice([150, 199, 200, 201, 260, 900])) for _ in range(12)] + ["-" * 260, "ab" * 150, "=" * 1200, (word(7) * 60)[:400]]
    boiler = word(205)
    docs = []
    for i in range(n):
        t = word(rnd.randrange(0, 600))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            p = rnd.choice(passages)
            a = rnd.choice([0, 0, rnd.randrange(0, 30)])
            t = t[: len(t) // 2] + p[a:] + t[len(t) // 2 :]
        if i % 3 == 0:
            t = word(rnd.randrange(5)) + boiler + t
        docs.append((i, t))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1]), docs[5], (n + 2, None), (None, boiler), (n + 3, ""), (n + 4, "-" * 5000), (n + 5, "x" * 199)]
    return docs


def found(spark, docs, parts=3, **more):
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, key string, doc int").repartition(parts)
    return {tuple(r) for r in longspans.shared_stretches(df, **more).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    assert found(spark, docs) == brute(docs) != set()


def test_hot_anchors_and_small_batches(spark, monkeypatch):
    docs = corpus(4)
    monkeypatch.setattr(longspans, "HOT_SHARE", 1 << 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert found(spark, docs, hot_rows=3) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_settling_inside_one_batch(spark):
    docs = corpus(5)
    assert found(spark, docs, parts=1) == brute(docs)


def merged(docs):
    """brute's stretches joined by id, as the places of an id's texts are."""
    out = set()
    each = brute(docs)
    for d in {d for d, _, _ in each}:
        reach, begin = 0, None
        for s, n in sorted((s, n) for k, s, n in each if k == d):
            if begin is not None and s > reach:
                out.add((d, begin, reach - begin))
                begin = None
            begin, reach = s if begin is None else begin, max(reach, s + n)
        out.add((d, begin, reach - begin))
    return out


@pytest.mark.parametrize("batch", [1, 2, 3, 10_000])
def test_an_id_with_several_texts(spark, batch):
    """Whether what another document shares is met in one batch or in several must not change what an id's further texts share."""
    rnd = random.Random(11)
    word = lambda k: "".join(rnd.choice("가나다라마바사 abcde.\n1") for _ in range(k))
    docs = []
    for i in range(0, 40, 2):
        p = word(300)
        docs += [(i, p), (i + 1, p), (i, word(900) + p[:260] + word(50)), (i, word(2000) + p[40:])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = found(spark, docs, parts=1), found(spark, docs, parts=5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == merged(docs)


def test_longer_spans(spark, monkeypatch):
    docs = corpus(6)
    monkeypatch.setitem(globals(), "LEAST", 300)
    assert found(spark, docs, least=300) == brute(docs)
    with pytest.raises(ValueError):
        longspans.shared_stretches(spark.createDataFrame([], "doc_id long, text string"), least=80)


def test_empty(spark):
    assert found(spark, []) == set()


def keys_of(text, least=LEAST):
    """The key of each window of a text."""
    x = longspans.Anchors([text], least)
    own = np.zeros(max(0, len(text) - least + 1), np.int64)
    count = np.zeros(len(own), int)
    for key, lo, hi in zip(x.key, x.lo, x.hi):
        own[lo : hi + 1] = key
        count[lo : hi + 1] += 1
    assert (count == 1).all()
    return own


def assert_same_keys(shared, around, least=LEAST):
    n = len(shared) - least + 1
    runs = [keys_of(before + shared + after, least)[len(before) : len(before) + n] for before, after in around]
    assert all((r == runs[0]).all() for r in runs)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab가 .", min_size=200, max_size=260), st.text(alphabet="ab가 .-", max_size=80), st.text(alphabet="ab가 .-", max_size=80), st.text(alphabet="ab가 .-", max_size=80), st.text(alphabet="ab가 .-", max_size=80))
def test_a_shared_window_has_one_key(shared, a, b, c, d):
    """Every window of `LEAST` characters that two texts have in common is known by the same key in both."""
    assert_same_keys(shared, [(a, b), (c, d)])


def periodic(rnd, n, depth=0):
    """A text of nested repetitions: runs, periods of runs, periods of these."""
    if depth == 0 or rnd.random() < 0.2:
        return rnd.choice("ab-. ") * rnd.choice([1, 2, 3, 5, 6, 13, 15, 28, 31, 34, 70])
    unit = "".join(periodic(rnd, n, depth - 1) for _ in range(rnd.choice([1, 2, 3])))
    return (unit * rnd.choice([1, 2, 3, 5, 9]))[: 2 * n]


def test_a_run_that_goes_on_on_one_side_only():
    w = "b" * 28 + "a" * 6 + ("b" * 34 + "a" * 6) * 4 + "b" * 6
    rnd = random.Random(3)
    noise = lambda: "".join(rnd.choice("가나다라마바사 xyz") for _ in range(200))
    assert len(w) == LEAST
    for _ in range(50):
        assert_same_keys(w, [("b" * 200, noise()), (noise(), noise()), ("", "b" * 99), (noise(), "")])


def test_such_a_run_end_to_end(spark):
    w = "b" * 28 + "a" * 6 + ("b" * 34 + "a" * 6) * 4 + "b" * 6
    rnd = random.Random(3)
    noise = lambda: "".join(rnd.choice("가나다라마바사 xyz") for _ in range(200))
    x = "ab" * 60 + "a" * 31 + "ba" * 25 + "a" * 4
    docs = [(1, "b" * 200 + w + noise()), (2, noise() + w + noise()), (3, "ab" * 90 + x + noise()), (4, "a" * 90 + x + "a" * 31), (5, noise() + x)]
    assert found(spark, docs) == brute(docs)
    assert {d for d, _, _ in brute(docs)} == {1, 2, 3, 4, 5}


def test_nested_periods():
    """Windows of nested repetitions keep their key whatever stands around them, also where it carries the repetition on."""
    rnd = random.Random(12)
    windows = 0
    while windows < 20_000:
        text = "".join(periodic(rnd, 300, 3) for _ in range(2))
        if len(text) < 230:
            continue
        at = rnd.randrange(len(text) - 220)
        shared = text[at : at + rnd.randrange(200, 320)]
        around = [(text[max(0, at - 150) : at], text[at + len(shared) :][:150])]
        for _ in range(3):
            before, after = (periodic(rnd, 100, 2)[-150:] for _ in range(2))
            around.append((before + rnd.choice(["", shared[0] * rnd.randrange(80)]), rnd.choice(["", shared[-1] * rnd.randrange(80)]) + after))
        assert_same_keys(shared, around)
        windows += 4 * (len(shared) - LEAST + 1)


def test_symbols_depend_on_their_reach_only():
    """STEPS' bound on what a symbol depends on, tried with other texts beyond it."""
    rnd = random.Random(7)
    left, right = longspans.REACH
    begins = lambda t: dict(zip(*reversed(longspans.recompress(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0]))), strict=True))
    for _ in range(2000):
        part = "".join(rnd.choice("aab") * rnd.choice([1, 1, 2, 3, 4, 7]) for _ in range(60))[: left + right + 30]
        x, y = (begins("".join(rnd.choice("ab") * rnd.randrange(1, 9) for _ in range(9))[:40].rjust(40, "c") + part + "".join(rnd.choice("ab") for _ in range(40))) for _ in range(2))
        for p in range(40 + left, 40 + len(part) - right + 1):
            assert x.get(p) == y.get(p)


def test_repetitions_are_one_row():
    x = longspans.Anchors(["=" * 5000], LEAST)
    assert len(x.key) == 1 and x.lo[0] == 0 and x.hi[0] == 5000 - LEAST
    assert len(longspans.Anchors(["=" * 200_000], LEAST).key) == -(-(200_000 - LEAST + 1) // (1 << 15))


def test_filter_grows_with_what_it_holds():
    assert longspans.filter_bits(0) == longspans.FILTER_BITS[0]
    assert 8 <= longspans.filter_bits(100_000) / 100_000 <= 16
    assert longspans.filter_bits(10**12) == longspans.FILTER_BITS[1]


def test_segments_hold_every_window(monkeypatch):
    monkeypatch.setattr(longspans, "CHUNK_CHARS", 500)
    rnd = random.Random(1)
    text = "".join(rnd.choice("가나다라 ") for _ in range(3000))
    pieces, row, offset = longspans._segments([text, "short"], LEAST, 500)
    assert all(text[o : o + len(p)] == p for p, r, o in zip(pieces, row, offset) if r == 0)
    whole = longspans.Anchors([text], LEAST)
    want = {s: int(k) for k, lo, hi in zip(whole.key, whole.lo, whole.hi) for s in range(lo, hi + 1)}
    got = {}
    parts = longspans.Anchors(pieces, LEAST)
    for k, o, lo, hi in zip(parts.key, parts.owner, parts.lo, parts.hi):
        for s in range(lo, hi + 1):
            got[int(s - parts.begins[o] + offset[o])] = int(k)
    assert got == want and len(want) == len(text) - LEAST + 1


def test_rolling_hash():
    points = np.frombuffer("가나가나다".encode("utf-32-le"), np.uint32)
    h = longspans.RollingHash(points).between(np.array([0, 2, 1]), np.array([2, 4, 3]))
    assert h[0] == h[1] != h[2]


def test_report(spark):
    docs = spark.createDataFrame([(1, "x" * 400), (2, None), (None, "y")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 1, 200)], "doc_id long, start_at int, span_len int")
    assert rows(longspans.shared_report(docs, spans)) == [(1, 400, 1, 200, 0.5), (2, 0, 0, 0, 0.0)]
