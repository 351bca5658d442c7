"""Applying a feed of inserts, updates and deletes: per-bucket embedded DuckDB upserts.

Each change becomes a small state row of its key: the sequence and kind of the last reset (insert or delete) and,
for every field, the last value carried with its sequence. Merging two states keeps, field by field, what has the
greater sequence, so changes may come repeatedly, out of order and in any batches: the result is that of applying
each once and in turn. Deletes stay as tombstones, so that an older change that arrives later can't revive a key.

The upsert runs twice, with the same SQL: over every input partition before the shuffle (a key with a third of all
changes is then one row a partition), and over every hash bucket after it. A bucket's DuckDB holds one row a key;
its memory is limited, beyond that it spills to the task's own scratch folder, which dies with the task.

A stored state keeps its buckets in version folders, told by a manifest: a batch rewrites the buckets that it touches, exports them to a
new folder, and publishes all at once by switching the pointer to the new manifest.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.session import cut_lineage

MEMORY_LIMIT = "256MB"
BUCKET_ROWS = 500_000
ABSENT = -1  # the sequence of a field, or of a reset, that was never seen


def change_states(changes: DataFrame, keys: dict[str, Column], seq: Column, op: Column, fields: dict[str, Column]) -> DataFrame:
    """One state row a change: keys, reset_seq, reset_op, and f, f_seq for every field (as strings).

    op: 'I', 'U' or 'D' once trimmed and in upper case; other kinds, null keys and null sequences are left out.
    An insert carries all fields, nulls too; an update only those that aren't null; a delete none.
    """
    kind = F.upper(F.trim(op))
    rows = changes.select(*[c.cast("string").alias(k) for k, c in keys.items()], seq.cast("long").alias("seq"), kind.alias("op"), *[c.cast("string").alias(f) for f, c in fields.items()])
    known = F.col("op").isin("I", "U", "D") & F.col("seq").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = rows.where(known)
    carried = {f: (F.col("op") == "I") | ((F.col("op") == "U") & F.col(f).isNotNull()) for f in fields}
    reset = F.col("op") != "U"
    return rows.select(
        *keys,
        F.when(reset, F.col("seq")).otherwise(ABSENT).alias("reset_seq"),
        F.when(reset, F.col("op")).alias("reset_op"),
        *[x for f in fields for x in (F.when(carried[f], F.col(f)).alias(f), F.when(carried[f], F.col("seq")).otherwise(ABSENT).alias(f"{f}_seq"))],
    )


def upsert_sql(keys: list[str], fields: list[str]) -> tuple[str, str]:
    """The state table and the statement that merges the Arrow batch named `batch` into it."""
    pairs = [("reset_op", "reset_seq"), *[(f, f"{f}_seq") for f in fields]]
    columns = [*[f'"{k}" VARCHAR' for k in keys], *[f'"{v}" VARCHAR, "{s}" BIGINT' for v, s in pairs]]
    create = f"CREATE TABLE state ({', '.join(columns)}, PRIMARY KEY ({', '.join(f'"{k}"' for k in keys)}))"
    by_key = ", ".join(f'"{k}"' for k in keys)
    # arg_max_null keeps a null that an insert carried; equal sequences are repetitions of one change.
    newest = ", ".join(f'arg_max_null("{v}", "{s}") AS "{v}", max("{s}") AS "{s}"' for v, s in pairs)
    names = ", ".join([by_key, *[f'"{v}", "{s}"' for v, s in pairs]])
    keep = ", ".join(
        f'"{v}" = CASE WHEN excluded."{s}" > state."{s}" THEN excluded."{v}" ELSE state."{v}" END, "{s}" = greatest(excluded."{s}", state."{s}")' for v, s in pairs
    )
    later = " OR ".join(f'excluded."{s}" > state."{s}"' for _, s in pairs)
    upsert = f"INSERT INTO state ({names}) SELECT {by_key}, {newest} FROM batch GROUP BY {by_key} ON CONFLICT DO UPDATE SET {keep} WHERE {later}"
    return create, upsert


class _Upsert:
    """One bucket's embedded database: takes Arrow batches, yields the merged state.

    flush: as a combiner, hand on the state whenever it has so many rows and begin anew; None: keep all until the end.
    """

    def __init__(self, keys: list[str], fields: list[str], memory: str, flush: int | None = None):
        self.create, self.upsert = upsert_sql(keys, fields)
        self.memory, self.flush = memory, flush

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        scratch = tempfile.mkdtemp(prefix="bucket-")
        try:
            with duckdb.connect(config={"threads": 1, "memory_limit": self.memory, "temp_directory": scratch}) as db:
                db.execute(self.create)
                for batch in batches:
                    if batch.num_rows:
                        db.register("batch", pa.Table.from_batches([batch]))
                        db.execute(self.upsert)
                        db.unregister("batch")
                        if self.flush and db.execute("SELECT count(*) FROM state").fetchall()[0][0] >= self.flush:
                            yield from db.sql("FROM state").to_arrow_reader(50_000)
                            db.execute("DROP TABLE state")
                            db.execute(self.create)
                yield from db.sql("FROM state").to_arrow_reader(50_000)
        finally:
            shutil.rmtree(scratch, ignore_errors=True)


def state_schema(keys: list[str], fields: list[str]) -> str:
    return ", ".join([*[f"`{k}` string" for k in keys], "reset_op string, reset_seq long", *[f"`{f}` string, `{f}_seq` long" for f in fields]])


def schema_names(keys: list[str], fields: list[str]) -> list[str]:
    return [*keys, "reset_op", "reset_seq", *[x for f in fields for x in (f, f"{f}_seq")]]


def merge_states(states: DataFrame, keys: list[str], fields: list[str], buckets: int | None = None, memory: str = MEMORY_LIMIT, flush: int = BUCKET_ROWS) -> DataFrame:
    """One state row a key, tombstones included.

    buckets: by default as many as keep a bucket near BUCKET_ROWS keys at most, and as tasks that can run at once at least; an
    embedded database's index must fit its memory, so their number has to follow the rows.
    """
    buckets = buckets or max(states.sparkSession.sparkContext.defaultParallelism, -(-states.count() // BUCKET_ROWS))
    schema = state_schema(keys, fields)
    combined = states.select(*schema_names(keys, fields)).mapInArrow(_Upsert(keys, fields, memory, flush), schema)
    return combined.repartition(buckets, *keys).mapInArrow(_Upsert(keys, fields, memory), schema)


def current_rows(states: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The records that exist: last reset an insert; fields as carried since. An update of what doesn't exist does nothing."""
    return states.where(F.col("reset_op") == "I").select(*keys, *[F.when(F.col(f"{f}_seq") >= F.col("reset_seq"), F.col(f)).alias(f) for f in fields])


def apply_changes(changes: DataFrame, keys: dict[str, Column], seq: Column, op: Column, fields: dict[str, Column], stored: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """The merged state after the changes, on top of a stored state if given; an empty feed gives the stored state."""
    states = change_states(changes, keys, seq, op, fields)
    if stored is not None:
        states = states.unionByName(stored)
    return merge_states(states, [*keys], [*fields], buckets)


def publish(df: DataFrame, root: str) -> str:
    """Write the whole of df to a new version folder under root and switch the pointer in one rename; readers see the old or the new whole.

    A job that dies before the switch leaves an unreferenced folder and the old version in force. Works on any Hadoop
    file system with an atomic rename.
    """
    version = new_version()
    df.write.parquet(os.path.join(root, version))
    switch(df.sparkSession, root, version)
    return version


def read_published(spark: SparkSession, root: str) -> DataFrame | None:
    """The version in force, or None before the first."""
    version = current(spark, root)
    return None if version is None else spark.read.parquet(os.path.join(root, version))


# --- a state in buckets, of which a batch rewrites those that it touches


@dataclass
class Manifest:
    """Which version folder holds each bucket of a state, and its rows; buckets without rows are in none."""

    buckets: int
    at: dict[int, str] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    before: list[str] = field(default_factory=list)  # folders of the manifest before, kept for its readers


def read_manifest(spark: SparkSession, root: str) -> Manifest | None:
    version = current(spark, root)
    if version is None:
        return None
    got = json.loads("\n".join(r[0] for r in spark.read.text(os.path.join(root, version, "manifest"), wholetext=True).collect()))
    return Manifest(got["buckets"], {int(k): v for k, v in got["at"].items()}, {int(k): v for k, v in got["rows"].items()}, got["before"])


def _of_manifest(spark: SparkSession, root: str, manifest: Manifest | None, keys: list[str], fields: list[str], only: list[int] | None = None) -> DataFrame:
    paths = [os.path.join(root, v, f"bucket={b}") for b, v in (manifest.at if manifest else {}).items() if only is None or b in set(only)]
    schema = state_schema(keys, fields)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_state(spark: SparkSession, root: str, keys: list[str], fields: list[str]) -> DataFrame:
    """The state in force, tombstones included; empty before the first batch."""
    return _of_manifest(spark, root, read_manifest(spark, root), keys, fields)


def apply_batch(changes: DataFrame, root: str, keys: dict[str, Column], seq: Column, op: Column, fields: dict[str, Column], bucket_rows: int = BUCKET_ROWS, memory: str = MEMORY_LIMIT) -> list[int]:
    """Merge a batch of changes into the state under root and publish it atomically; the buckets that were rewritten.

    Only buckets to which a change of the batch belongs are read and written; what the others hold stays in the folders where it is, and the
    manifest says so. Once buckets hold more than bucket_rows rows on average, all are rewritten into twice as many or more. Folders that
    neither the new manifest nor the one before it names are deleted. A batch that is applied again changes nothing.
    """
    spark = changes.sparkSession
    names, values = [*keys], [*fields]
    manifest = read_manifest(spark, root) or Manifest(spark.sparkContext.defaultParallelism)
    total = sum(manifest.rows.values())
    grown = total > manifest.buckets * bucket_rows
    buckets = max(2 * manifest.buckets, -(-2 * total // bucket_rows)) if grown else manifest.buckets
    schema = state_schema(names, values)
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int")
    fresh = cut_lineage(change_states(changes, keys, seq, op, fields).select(*schema_names(names, values)).mapInArrow(_Upsert(names, values, memory, BUCKET_ROWS), schema).withColumn("bucket", bucket))
    touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most as many numbers as there are buckets
    stored = _of_manifest(spark, root, manifest, names, values, None if grown else touched)
    if not touched and not grown:
        return []
    both = fresh.unionByName(stored.withColumn("bucket", bucket))
    merged = both.repartition(buckets if grown else len(touched), "bucket").drop("bucket").mapInArrow(_Upsert(names, values, memory), schema)
    version = new_version()
    path = os.path.join(root, version)
    merged.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)
    sizes = {r["bucket"]: r["count"] for r in spark.read.parquet(path).groupBy("bucket").count().collect()}
    at = ({} if grown else manifest.at) | dict.fromkeys(sizes, version)
    rows = ({} if grown else manifest.rows) | sizes
    old = sorted(set(manifest.at.values()))
    told = json.dumps({"buckets": buckets, "at": at, "rows": rows, "before": old})
    spark.createDataFrame([(told,)], "manifest string").coalesce(1).write.text(os.path.join(path, "manifest"))
    switch(spark, root, version)
    for spare in set(manifest.before) - set(at.values()) - set(old):
        fs, folder = _fs(spark, os.path.join(root, spare))
        fs.delete(folder, True)
    return touched


def new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def switch(spark: SparkSession, root: str, version: str) -> None:
    """Put a version in force by one atomic rename of the pointer."""
    fs, path = _fs(spark, root)
    jvm = spark.sparkContext._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(path, f".CURRENT-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(path, "CURRENT"), options)


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the version in force."""
    fs, path = _fs(spark, root)
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "CURRENT")
    if not fs.exists(pointer):
        return None
    name = spark.read.text(pointer.toString()).first()[0].strip()
    if not re.fullmatch(r"v-[0-9a-f]{32}", name):
        raise ValueError(f"damaged pointer in {root}")
    return name


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
