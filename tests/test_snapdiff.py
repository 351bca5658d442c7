import datetime as dt
import random

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.operators import snapdiff

members = st.sets(st.integers(0, 200_000), max_size=300)


@settings(max_examples=40, deadline=None)
@given(members, members)
def test_bitmaps(a, b):
    x, y = (snapdiff.OrdinalSet.of(np.array(list(s), np.int64)) for s in (a, b))
    assert x.andnot(y).tolist() == sorted(a - b)
    assert x.both(y).tolist() == sorted(a & b)
    assert x.ordinals().tolist() == sorted(a)
    assert x.rank(np.array(sorted(a), np.int64)).tolist() == list(range(len(a)))


def test_dense_containers_are_bits():
    x = snapdiff.OrdinalSet.of(np.arange(70_000))
    assert x.nbytes() <= 8192 + 2 * 4464
    assert len(x.ordinals()) == 70_000


def brute(data, days):
    last = {}
    for k, d, v, t in data:
        if k is not None and d is not None and ((k, d) not in last or last[k, d][0] < (t, v is not None, v or "")):
            last[k, d] = (t, v is not None, v or ""), v
    days = sorted({d for d in days if d})
    out = set()
    for a, b in zip(days, days[1:]):
        for k in {k for k, _ in last}:
            x, y = last.get((k, a)), last.get((k, b))
            if x and y and x[1] != y[1]:
                out.add((k, b, "changed"))
            elif y and not x:
                out.add((k, b, "added"))
            elif x and not y:
                out.add((k, b, "removed"))
    return sorted(out, key=repr)


SCHEMA = "k string, d date, v string, t long, bucket int, ordinal string"


def diff(spark, data, days, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA)
    latest = snapdiff.latest_rows(df, F.col("k"), "d", F.col("v"), F.col("t"))
    return latest, snapdiff.snapshot_changes(latest, spark.createDataFrame([(d,) for d in days], "day date"), 3, **more)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    days = [dt.date(2024, m, 1) for m in range(1, 7)]
    data = [(rnd.choice([None, *map(str, range(50))]), rnd.choice([*days[:3], *days[4:], None]), rnd.choice([None, "a", "b", ""]), rnd.randrange(5)) for _ in range(900)]
    data += [("hot", days[0], "x", i) for i in range(400)]
    _, out = diff(spark, data, [*days, None, days[0]])
    assert rows(out) == brute(data, days)
    assert rows(out, "change") != []


def test_empty_and_single(spark):
    assert rows(diff(spark, [], [])[1]) == []
    assert rows(diff(spark, [("a", dt.date(2024, 1, 1), "v", 1)], [dt.date(2024, 1, 1)])[1]) == []
    d = [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    assert rows(diff(spark, [("a", d[0], None, 1)], d)[1]) == [("a", d[1], "removed")]


def test_ordinals_persist(spark):
    d = [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    first, _ = diff(spark, [(str(i), d[0], "v", 1) for i in range(20)], d[:1])
    known = snapdiff.key_ordinals(first, 3)
    old = {r.key: (r.bucket, r.ordinal) for r in known.collect()}
    known = spark.createDataFrame([(k, *v) for k, v in old.items()], "key string, bucket int, ordinal long")
    data = [(str(i), d[0], "v", 1) for i in range(20)] + [(str(i), d[1], "w" if i % 2 else "v", 1) for i in range(5, 30)]
    latest, out = diff(spark, data, d, known=known)
    assert rows(out) == brute(data, d)
    new = {r.key: (r.bucket, r.ordinal) for r in snapdiff.key_ordinals(latest, 3, known).collect()}
    assert {k: new[k] for k in old} == old
    assert len(set(new.values())) == len(new) == 30
    for b in range(3):
        assert sorted(o for x, o in new.values() if x == b) == list(range(sum(x == b for x, _ in new.values())))
