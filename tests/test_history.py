import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexstrata.operators import history
from lexstrata.session import written

SCHEMA = "k string, id long, start date, stop date, hash string, mst string, loaded long, hash_diff string, at string, e string"


def day(n):
    return None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute(data):
    first, best = {}, {}
    for k, i, s, e, h, m, t in data:
        if s is not None:
            first[i, k, s] = min(first.get((i, k, s), t), t)
    for k, i, s, e, h, m, t in data:
        if s is not None and ((k, s) not in best or best[k, s][0] < (first[i, k, s], i)):
            best[k, s] = (first[i, k, s], i), (k, s, e, h, m)
    out = []
    for k in {x[0] for x in best}:
        own = sorted((v for (kk, _), (_, v) in best.items() if kk == k), key=lambda v: v[1])
        for n, (_, s, e, h, m) in enumerate(own):
            nxt = own[n + 1][1] if n + 1 < len(own) else None
            end = min([x for x in (e, nxt) if x], default=None)
            if end is not None and end <= s:
                continue
            if out and out[-1][0] == k and out[-1][3] == s and out[-1][4] == h:
                out[-1][3] = end
            else:
                out.append([k, m, s, end, h])
    return sorted((tuple(x) for x in out), key=repr)


def deliveries(spark, data):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)
    return history.first_deliveries(df, ["k"], "start", "id", "loaded", ["stop", "hash", "mst"])


def load(spark, data, sat=None, seen=None):
    """(satellite, ids seen) after one more load."""
    fresh = history.new_deliveries(seen, deliveries(spark, data), ["k"], "start")
    more = history.satellite_rows(sat, fresh, ["k"], "start", ["hash"], ["stop", "mst"])
    ids = fresh.select("row_id", "k", "start")
    both = (more, ids) if sat is None else (sat.unionByName(more), seen.unionByName(ids))
    return tuple(written(x) for x in both)


def made(spark, data):
    return history.counting(deliveries(spark, data), ["k"], "start"), history.satellite_rows(None, deliveries(spark, data), ["k"], "start", ["hash"], ["stop", "mst"])


def periods(sat, **more):
    return rows(history.periods(sat, ["k"], "start", "stop", ["hash"], **more), "k", "mst", "start", "stop", "hash")


def random_versions(seed, n=500):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        s = rnd.choice([None, *range(40)])
        row = (rnd.choice([None, "a", "b", "c", "d"]), i, day(s), rnd.choice([None, day((s or 0) + rnd.randrange(0, 9))]), rnd.choice([None, "h1", "h2", ""]), f"m{i % 3}", rnd.randrange(50))
        data.append(row)
        if i % 7 == 0:
            data.append((*row[:-1], row[-1] + 5))
    return data


def test_against_brute_force(spark):
    data = random_versions(5)
    want = brute(data)
    sat = made(spark, data)[1]
    assert periods(sat) == periods(sat, one_load=True) == want


@pytest.mark.parametrize("cuts", [[1], [25], [49], [10, 30]])
def test_loads_at_any_split(spark, cuts):
    """Loads by load time, each only appending, give what one load of all gives."""
    data = random_versions(6, 200)
    sat = seen = None
    sizes = []
    for lo, hi in zip([-1, *cuts], [*cuts, 99]):
        sat, seen = load(spark, [r for r in data if lo <= r[-1] < hi], sat, seen)
        sizes.append(sat.count())
    assert periods(sat) == brute(data)
    assert sizes == sorted(sizes)


def test_a_later_load_overrules_an_end(spark):
    a, b = ("k", 1, day(0), day(5), "h", "m1", 1), ("k", 2, day(5), None, "h", "m2", 2)
    sat, seen = load(spark, [a])
    assert periods(load(spark, [b], sat, seen)[0]) == [("k", "m1", day(0), None, "h")]
    b = (*b[:4], "g", *b[5:])
    got = load(spark, [b], sat, seen)[0]
    assert periods(got) == periods(got.orderBy(F.desc("start"))) == [("k", "m1", day(0), day(5), "h"), ("k", "m2", day(5), None, "g")]
    b = ("k", 2, day(3), None, "g", "m2", 2)
    assert periods(load(spark, [b], sat, seen)[0]) == [("k", "m1", day(0), day(3), "h"), ("k", "m2", day(3), None, "g")]


def test_a_load_appends_changes_only(spark):
    a = ("k", 1, day(0), None, "h", "m1", 1)
    sat, seen = load(spark, [a])
    again = [(*a[:-1], 7), ("k", 9, *a[2:-1], 8)]  # the id delivered again; another id of the same content
    sat, seen = load(spark, again, sat, seen)
    assert sat.count() == 1 and seen.count() == 2
    sat, seen = load(spark, [("k", 10, day(0), None, "g", "m1", 9)], sat, seen)
    assert sat.count() == 2 and periods(sat) == [("k", "m1", day(0), None, "g")]
    sat, seen = load(spark, [("k", 9, *a[2:-1], 11)], sat, seen)  # its load time is its first
    assert sat.count() == 2


def test_gap_touch_and_tie(spark):
    data = [
        ("a", 1, day(0), day(5), "h", "m1", 1), ("a", 2, day(5), day(9), "h", "m2", 1),  # touch, equal: one
        ("b", 3, day(0), day(5), "h", "m1", 1), ("b", 4, day(6), None, "h", "m2", 1),  # gap: two
        ("c", 5, day(0), None, "h", "m1", 3), ("c", 6, day(0), None, "g", "m2", 3),  # tie: largest id
        ("d", 7, day(3), day(3), "h", "m1", 1),  # never held
    ]
    assert periods(made(spark, data)[1]) == [("a", "m1", day(0), day(9), "h"), ("b", "m1", day(0), day(5), "h"), ("b", "m2", day(6), None, "h"), ("c", "m2", day(0), None, "g")]


def test_empty(spark):
    assert periods(made(spark, [])[1]) == []


def test_rates_and_split(spark):
    data = [("a", i, day(i), None, f"h{i}", "same", i) for i in range(10)]
    rates = history.change_rates(made(spark, data)[0], ["k"], "start", ["hash", "mst"])
    assert {r.attribute: r.rate for r in rates.collect()} == {"hash": 1.0, "mst": 0.0}
    assert history.split_by_rate(rates) == {"slow": ["mst"], "fast": ["hash"]}


def test_current_on_a_day(spark):
    sat = made(spark, [("a", 1, day(0), day(5), "h", "m1", 1)])[1]
    view = history.periods(sat, ["k"], "start", "stop", ["hash"])
    hits = [view.where(history.holds_on("start", "stop", F.lit(day(n)).cast("date"))).count() for n in (-1, 0, 4, 5)]
    assert hits == [0, 1, 1, 0]


def test_a_counting_row_that_never_held_ends_the_one_before(spark, tmp_path):
    """A period runs to the next counting row's start, also if that row's own period is empty; what follows doesn't touch it."""
    from lexstrata.plans import problems

    data = [(1, 100, 1, dt.date(2020, 1, 1), None, "h"), (2, 100, 2, dt.date(2021, 1, 1), dt.date(2021, 1, 1), "x"), (3, 100, 3, dt.date(2022, 1, 1), None, "h"), (4, 200, 1, dt.date(2020, 1, 1), None, "h"), (5, 200, 2, dt.date(2021, 1, 1), dt.date(2020, 6, 1), "x")]
    df = spark.createDataFrame([("L", *r) for r in data], "law_id string, id long, article_no int, no int, valid_from date, valid_to date, content_hash string")
    cols = ["*", F.lit(None).cast("int").alias("paragraph_no"), F.lit(None).cast("timestamp").alias("deleted_at"), F.timestamp_seconds("no").alias("loaded_at"), F.concat(F.lit("m"), "no").alias("version_mst"), F.lit("t").alias("title")]
    df.select(*cols).write.parquet(f"{tmp_path}/law_articles.parquet")
    got = rows(problems.p5_found(spark, str(tmp_path)), "article_no", "version_mst", "valid_from", "valid_to")
    assert got == [(100, "m1", "2020-01-01", "2021-01-01"), (100, "m3", "2022-01-01", ""), (200, "m1", "2020-01-01", "2021-01-01")]
