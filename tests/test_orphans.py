import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexstrata.operators import orphans

REFS = "ref_name string, row_id long, key string, at timestamp_ntz, spans string, salt int"
PARENTS = "key string, born timestamp_ntz, gone timestamp_ntz"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(refs, parents):
    out = set()
    for name, row, key, at, *_ in refs:
        if key is None:
            continue
        spans = [(b or dt.datetime.min, g or dt.datetime.max) for k, b, g in parents if k == key]
        if not spans:
            kind = "missing"
        elif at is None or any(b <= at < g for b, g in spans):
            continue
        else:
            kind = "deleted" if any(g <= at for _, g in spans) else "late"
        out.add((name, row, kind, at and at.strftime("%Y-%m")))
    return sorted(out, key=repr)


def found(spark, refs, parents, **more):
    p = orphans.parent_intervals(spark.createDataFrame(parents, PARENTS), F.col("key"), F.col("born"), F.col("gone"))
    return rows(orphans.find_orphans(spark.createDataFrame(refs, REFS), p, **more))


def test_kinds_and_boundaries(spark):
    parents = [("a", day(10), day(20)), ("b", day(10), None), ("c", None, day(5)), ("a", day(10), day(20)), (None, day(1), None)]
    refs = [("r", i, k, day(n), "x", 1) for i, (k, n) in enumerate([("a", 9), ("a", 10), ("a", 19), ("a", 20), ("b", 9), ("b", 99), ("c", 4), ("c", 5), ("z", 1), (None, 1), ("", 3), ("z", None), ("a", None)])]
    refs += refs[:3]
    expected = brute(refs, parents)
    assert found(spark, refs, parents) == expected
    assert {k for _, _, k, _ in expected} == set(orphans.KINDS)


@pytest.mark.parametrize("salted", [True, False])
def test_random_with_a_hot_key(spark, salted, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_SHARE", 10)
    rnd = random.Random(3)
    parents = [(f"k{rnd.randrange(40)}", day(rnd.randrange(100)), rnd.choice([None, day(100 + rnd.randrange(50))])) for _ in range(60)]
    refs = [("r", i, "k1" if i % 3 == 0 else f"k{rnd.randrange(60)}", day(rnd.randrange(200)), "", 0) for i in range(3000)]
    assert found(spark, refs, parents, salted=salted) == brute(refs, parents)


def test_empty_tables(spark):
    assert found(spark, [], [("a", None, None)]) == []
    assert found(spark, [("r", 1, "a", day(1), "", 0)], []) == [("r", 1, "missing", "2024-01")]
    assert found(spark, [], []) == []


def test_presence_in_snapshots(spark):
    d = [dt.date(2021, 1, 1), dt.date(2022, 1, 1), dt.date(2023, 1, 1)]
    snaps = spark.createDataFrame([("a", d[0]), ("a", d[2]), ("b", d[1]), ("c", d[0]), ("c", d[1]), ("c", d[2]), (None, d[1]), ("e", None)], "key string, d date")
    parents = orphans.presence_intervals(snaps, F.col("key"), "d")
    at = [dt.datetime(2020, 6, 1), dt.datetime(2021, 1, 1), dt.datetime(2022, 6, 1), dt.datetime(2024, 1, 1)]
    refs = spark.createDataFrame([("r", 10 * i + j, k, t) for i, k in enumerate("abcz") for j, t in enumerate(at)], "ref_name string, row_id long, key string, at timestamp_ntz")
    got = {(r.row_id): r.kind for r in orphans.find_orphans(refs, parents).collect()}
    assert got == {0: "late", 2: "deleted", 10: "late", 11: "late", 13: "deleted", 20: "late", 30: "missing", 31: "missing", 32: "missing", 33: "missing"}


def test_report(spark):
    df = spark.createDataFrame([("r", 1, "late", "2024-01"), ("r", 2, "late", "2024-01")], "ref_name string, row_id long, kind string, period string")
    assert rows(orphans.orphan_report(df)) == [("r", "2024-01", "late", 2)]
