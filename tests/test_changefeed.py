import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexstrata.operators import changefeed
from lexstrata.streaming import sync

SCHEMA = "n long, op string, k1 string, k2 string, a string, b string, state string, batch string, reset_seq string"


def parts():
    return {"keys": {"k1": F.trim("k1"), "k2": F.col("k2")}, "seq": F.col("n"), "op": F.col("op"), "fields": {"a": F.col("a"), "b": F.col("b")}}


def brute(changes):
    state = {}
    for n, op, k1, k2, a, b in sorted({c for c in changes if c[0] is not None}, key=lambda c: c[0]):
        if k1 is None or k2 is None or op is None:
            continue
        k, op = (k1.strip(), k2), op.strip().upper()
        if op == "I":
            state[k] = [a, b]
        elif op == "D":
            state.pop(k, None)
        elif op == "U" and k in state:
            state[k] = [x if x is not None else y for x, y in zip((a, b), state[k])]
    return sorted(((*k, *v) for k, v in state.items()), key=repr)


def feed(seed, n=800):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        out.append((i, rnd.choice(["I", "U", "U", " u", "d ", "x", None]), "hot" if hot else rnd.choice(["a", "b ", "c", None]), "1" if hot else rnd.choice(["1", "2", None]), rnd.choice([None, "p", "q", ""]), rnd.choice([None, "r", "s"])))
    out += rnd.sample(out, n // 4)
    rnd.shuffle(out)
    return out


def frame(spark, changes):
    return spark.createDataFrame([(*c, "x", "y", "z") for c in changes], SCHEMA)


def current(states):
    return rows(changefeed.current_rows(states, ["k1", "k2"], ["a", "b"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_repeats(spark, seed):
    changes = feed(seed)
    assert current(changefeed.apply_changes(frame(spark, changes).repartition(3), **parts(), buckets=3)) == brute(changes)


def test_in_pieces_with_tombstones(spark):
    changes = feed(7)
    third = len(changes) // 3
    stored = None
    for i in range(3):
        stored = changefeed.apply_changes(frame(spark, changes[i * third : None if i == 2 else (i + 1) * third]), **parts(), stored=stored, buckets=2)
    assert current(stored) == brute(changes)
    late = changefeed.apply_changes(frame(spark, [(5, "I", "z", "1", "p", "r")]), **parts(), stored=changefeed.apply_changes(frame(spark, [(9, "D", "z", "1", None, None)]), **parts()))
    assert current(late) == []


def test_combiner_hands_on_early(spark):
    changes = feed(3)
    p = parts()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        states = changefeed.change_states(frame(spark, changes).repartition(2), **p)
        assert current(changefeed.merge_states(states, ["k1", "k2"], ["a", "b"], 2, flush=3)) == brute(changes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert current(changefeed.apply_changes(frame(spark, []), **parts())) == []


def test_publish_switches_whole_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert changefeed.read_published(spark, root) is None
    changefeed.publish(spark.range(3), root)
    old = changefeed.read_published(spark, root)
    changefeed.publish(spark.range(5), root)
    assert old.count() == 3  # a reader of the old version isn't disturbed
    assert changefeed.read_published(spark, root).count() == 5


def test_stream_resumes(spark, tmp_path):
    changes = feed(11, 90)
    land, root, check = (str(tmp_path / x) for x in ("land", "state", "check"))
    for part in (changes[:50], changes[50:]):
        df = frame(spark, part).coalesce(1)
        df.write.mode("append").parquet(land)
        for _ in range(2):  # the second run finds nothing new
            sync.apply_feed(spark, land, df.schema, root, check, parts).awaitTermination()
    assert current(changefeed.read_state(spark, root, ["k1", "k2"], ["a", "b"])) == brute(changes)


def test_a_batch_rewrites_what_it_touches(spark, tmp_path):
    root, names = str(tmp_path / "s"), (["k1", "k2"], ["a", "b"])
    changes = feed(5, 300)
    assert current(changefeed.read_state(spark, root, *names)) == []
    assert changefeed.apply_batch(frame(spark, []), root, **parts()) == []
    changefeed.apply_batch(frame(spark, changes), root, **parts())
    first = changefeed.read_manifest(spark, root)
    assert current(changefeed.read_state(spark, root, *names)) == brute(changes)
    one = [(10_000, "I", "new", "key", "x", "y")]
    touched = changefeed.apply_batch(frame(spark, one), root, **parts())
    then = changefeed.read_manifest(spark, root)
    assert len(touched) == 1 and then.buckets == first.buckets > 1
    assert {b: v for b, v in then.at.items() if b not in touched} == {b: v for b, v in first.at.items() if b not in touched}
    assert current(changefeed.read_state(spark, root, *names)) == brute(changes + one)
    for n in range(3):  # again the same: nothing changes, and old folders go
        changefeed.apply_batch(frame(spark, changes), root, **parts())
    assert current(changefeed.read_state(spark, root, *names)) == brute(changes + one)
    assert len([f for f in (tmp_path / "s").iterdir() if f.name.startswith("v-")]) <= 3


def test_buckets_follow_the_rows(spark, tmp_path):
    root, names = str(tmp_path / "s"), (["k1", "k2"], ["a", "b"])
    changes = [(i, "I", f"k{i}", "1", "x", "y") for i in range(60)]
    for k in range(3):
        changefeed.apply_batch(frame(spark, changes[20 * k : 20 * k + 20]), root, **parts(), bucket_rows=4)
    manifest = changefeed.read_manifest(spark, root)
    assert manifest.buckets > spark.sparkContext.defaultParallelism and sum(manifest.rows.values()) == 60
    assert current(changefeed.read_state(spark, root, *names)) == brute(changes)
