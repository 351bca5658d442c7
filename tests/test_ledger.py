import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexstrata.functions import temporal
from lexstrata.operators import changefeed, checks, ledger

SCHEMA = "id long, law_id string, article_no int, paragraph_no int, title string, content string, content_hash string, version_mst string, valid_from date, valid_to date, is_current boolean"
IN = "law_id string, article_no int, paragraph_no int, title string, content string, content_hash string, version_mst string, valid_from date"
D = dt.date


def stored(spark, *rows_):
    return spark.createDataFrame([(i, "L", a, p, "t", c, c, "m0", s, e, cur) for i, a, p, c, s, e, cur in rows_], SCHEMA)


def incoming(spark, *rows_):
    return spark.createDataFrame([("L", a, p, "t", c, c, "m1", s) for a, p, c, s in rows_], IN)


BASE = (1, 100, None, "v1", D(2024, 1, 1), None, True)


@pytest.mark.parametrize(
    "content, start, status",
    [("v2", D(2099, 1, 1), "amended"), ("v1", D(2099, 1, 1), "same"), ("v0", D(2020, 1, 1), "stale"), ("v1-fixed", D(2024, 1, 1), "corrected")],
)
def test_reconcile(spark, content, start, status):
    got = ledger.reconcile(stored(spark, BASE), incoming(spark, (100, None, content, start), (200, None, "x", start)))
    assert {(r.article_no, r.status) for r in got.collect()} == {(100, status), (200, "added")}


def amended(spark):
    return ledger.apply_version(stored(spark, BASE), incoming(spark, (100, None, "v2", D(2099, 1, 1))), "L", F.lit(D(2099, 1, 1)))


def test_amend_promote_and_as_of(spark):
    after = ledger.assign_ids(amended(spark), ["law_id", "article_no", "valid_from"])
    assert rows(after, "id", "content", "valid_from", "valid_to", "is_current") == [(1, "v1", D(2024, 1, 1), D(2099, 1, 1), True), (2, "v2", D(2099, 1, 1), None, False)]
    at = lambda d: rows(after.where(temporal.in_force(temporal.as_day(d))), "content")
    assert [at(d) for d in ("2050-06-15", "2098-12-31", "2099-01-01", "2120-01-01", "1900-01-01")] == [[("v1",)], [("v1",)], [("v2",)], [("v2",)], []]
    count = lambda df, d: tuple(ledger.promote_counts(df, F.lit(d)).first())
    assert count(after, D(2098, 12, 31)) == (0, 0)
    assert count(after, D(2099, 1, 1)) == (1, 1)
    done = ledger.promote(after, F.lit(D(2099, 1, 1)))
    assert count(done, D(2099, 1, 1)) == (0, 0)
    assert rows(done, "content", "is_current") == [("v1", False), ("v2", True)]


def test_apply_version_branches(spark):
    old = stored(spark, BASE, (2, 200, None, "x", D(2024, 1, 1), None, True), (3, 300, 1, "p", D(2024, 1, 1), None, True), (4, 400, None, "later", D(2030, 1, 1), None, False), (5, 100, None, "v0", D(2020, 1, 1), D(2024, 1, 1), False))
    new = incoming(spark, (100, None, "v1", D(2025, 1, 1)), (300, 1, "p2", D(2024, 1, 1)), (500, None, "n", D(2025, 1, 1)))
    got = ledger.apply_version(old, new, "L", F.lit(D(2025, 1, 1)))
    assert rows(got, "id", "article_no", "content", "valid_to") == sorted(
        [(1, 100, "v1", None), (2, 200, "x", D(2025, 1, 1)), (3, 300, "p2", None), (4, 400, "later", None), (5, 100, "v0", D(2024, 1, 1)), (None, 500, "n", None)], key=repr
    )
    assert rows(ledger.removed_units(ledger.open_rows(old), new, spark.createDataFrame([("L", D(2025, 1, 1))], "law_id string, effective_on date")), "article_no", "conflict") == [(200, False), (400, True)]
    gone = ledger.apply_version(old, new.limit(0), "L", F.lit(D(2025, 1, 1)), repeal=True)
    assert rows(gone.where("valid_to is null"), "article_no") == [(400,)]


def test_versions_of_many_laws(spark):
    row = lambda i, law, a, c: (i, law, a, None, "t", c, c, "m0", D(2024, 1, 1), None, True)
    old = spark.createDataFrame([row(1, "A", 100, "x"), row(2, "B", 100, "x"), row(3, "C", 100, "x"), row(4, "D", 100, "x"), (5, None, 1, None, "t", "c", "c", "m", D(2024, 1, 1), None, True)], SCHEMA)
    new = spark.createDataFrame([(law, 100, None, "t", "y", "y", "m1", D(2025, 1, 1)) for law in "ABX"], IN)
    told = spark.createDataFrame([("A", D(2025, 1, 1), None), ("B", D(2025, 2, 1), True), ("C", D(2025, 3, 1), False), ("X", D(2025, 1, 1), False)], "law_id string, effective_on date, repeal boolean")
    got = rows(ledger.apply_versions(old, new, told), "law_id", "id", "content", "valid_from", "valid_to")
    assert got == sorted([
        ("A", 1, "x", D(2024, 1, 1), D(2025, 1, 1)), ("A", None, "y", D(2025, 1, 1), None), ("B", 2, "x", D(2024, 1, 1), D(2025, 2, 1)), ("C", 3, "x", D(2024, 1, 1), D(2025, 3, 1)),
        ("D", 4, "x", D(2024, 1, 1), None), ("X", None, "y", D(2025, 1, 1), None), (None, 5, "c", D(2024, 1, 1), None),
    ], key=repr)


def test_overlaps(spark):
    adjacent = stored(spark, (1, 1, None, "a", D(2024, 1, 1), D(2025, 1, 1), False), (2, 1, None, "b", D(2025, 1, 1), None, True), (3, 1, None, "e", D(2025, 6, 1), D(2025, 6, 1), False))
    assert ledger.overlap_flags(adjacent).count() == ledger.overlap_counts(adjacent).count() == 0
    clash = stored(spark, (1, 1, None, "a", D(2024, 1, 1), D(2025, 1, 1), False), (2, 1, None, "b", D(2024, 6, 1), D(2025, 6, 1), True))
    assert rows(ledger.overlap_flags(clash), "id") == [(2,)]
    rnd = random.Random(2)
    data = []
    for i in range(200):
        s = D(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60))
        data.append((i, rnd.randrange(3), rnd.choice([None, 1]), "c", s, rnd.choice([None, s + dt.timedelta(days=rnd.randrange(30))]), True))
    far = D(9999, 12, 31)
    pairs = {}
    for a in data:
        for b in data:
            if a[0] < b[0] and a[1:3] == b[1:3] and a[4] < (a[5] or far) and b[4] < (b[5] or far) and a[4] < (b[5] or far) and b[4] < (a[5] or far):
                pairs[a[1:3]] = pairs.get(a[1:3], 0) + 1
    assert {(r.article_no, r.paragraph_no): r.n_pairs for r in ledger.overlap_counts(stored(spark, *data)).collect()} == pairs


@pytest.mark.parametrize("seed", range(3))
def test_versions_in_sequence_keep_the_invariants(spark, seed):
    """After any sequence of versions: no overlaps, and exactly one version on every day inside coverage."""
    rnd = random.Random(seed)
    state = stored(spark).where("false")
    for n in range(4):
        start = D(2024 + n, 1, 1)
        keys = rnd.sample([(100, None), (100, 1), (200, None), (300, None)], rnd.randrange(1, 5))
        new = incoming(spark, *[(a, p, f"c{rnd.randrange(2)}", start) for a, p in keys])
        state = ledger.assign_ids(ledger.apply_version(state, new, "L", F.lit(start)), ["law_id", "article_no", "paragraph_no", "valid_from"])
        state = spark.createDataFrame(state.collect(), SCHEMA)
    assert ledger.overlap_flags(state).count() == 0
    assert {r.n_hits for r in ledger.boundary_hits(state).collect()} <= {0, 1}
    ids = [r.id for r in state.collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    assert {r.check_name: r.n_bad for r in checks.boundary_checks(state).collect()} == {"start_without_exactly_one": 0}
    assert tuple(ledger.promote_counts(ledger.promote(state, F.lit(D(2026, 5, 1))), F.lit(D(2026, 5, 1))).first()) == (0, 0)


def test_masters_and_maps(spark):
    s = spark.createDataFrame([("1", "a", "법률"), ("2", "b", "시행령")], "k string, name string, level string")
    i = spark.createDataFrame([("2", None, "x"), ("3", "c", "y")], "k string, name string, level string")
    assert rows(ledger.upsert_master(s, i, "k", ["level"])) == sorted([("1", "a", "법률"), ("2", None, "시행령"), ("3", "c", "y")], key=repr)
    assert rows(ledger.insert_absent(s, i, ["k"])) == [("1", "a", "법률"), ("2", "b", "시행령"), ("3", "c", "y")]
    f = spark.createDataFrame([("k", 1, "x"), ("j", 2, "y"), ("k", 3, None)], "k string, n int, v string")
    assert rows(ledger.first_position_last_value(f, ["k"], F.col("n"), ["v"])) == [("j", "y", 2), ("k", None, 1)]


def test_days(spark):
    spine = temporal.day_spine(spark, F.lit(D(2024, 2, 28)), F.lit(D(2024, 3, 1)))
    assert [r.day.day for r in spine.orderBy("day").collect()] == [28, 29, 1]
    assert temporal.day_spine(spark, F.lit(D(2024, 3, 1)), F.lit(D(2024, 2, 1))).count() == 0
    with pytest.raises(ValueError):
        temporal.as_day("2024-13-01")
    assert spark.range(1).select(temporal.as_day("") == F.current_date()).first()[0]


def test_watermark(spark, tmp_path):
    from lexstrata.sources import sinks

    root = str(tmp_path / "w")
    assert sinks.read_watermark(spark, root) is None
    sinks.write_watermark(spark, root, D(2024, 1, 2), dry_run=True)
    assert sinks.read_watermark(spark, root) is None
    sinks.write_watermark(spark, root, D(2024, 1, 2))
    sinks.write_watermark(spark, root, D(2024, 1, 3))
    assert sinks.read_watermark(spark, root) == D(2024, 1, 3)
    assert changefeed.read_published(spark, root).count() == 1
