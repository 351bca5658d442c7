"""What changed between full snapshots: persistent key ordinals, compressed bitmaps and aligned value vectors.

Every key gets an ordinal inside its hash bucket (bucket = hash of the key). A bucket's snapshot is then a
compressed bitmap of the ordinals present, in containers of 2**16 bits (packed bits, or a sorted array of 16-bit
offsets where that is smaller), and a vector of value codes in ordinal order. Per pair of consecutive snapshots
  added   = next AND NOT previous,
  removed = previous AND NOT next,
  changed = ordinals in previous AND next at which the aligned vectors differ.
Ordinals are kept between runs by passing what key_ordinals returned (and was written) as `known`: old keys keep
theirs, new keys get the numbers behind them. Known ordinals come to their bucket by themselves and are met with its rows there.

One shuffle thins repeated deliveries (combined map-side, so a key delivered a billion times is one row a
snapshot), a second groups by bucket; the number of buckets follows the rows, so a bucket is of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET_ROWS = 200_000
CONTAINER = 1 << 16
DIFF_SCHEMA = "rec_key string, snapshot_date date, change string"


class OrdinalSet:
    """Ordinals as compressed containers of 2**16: {high bits: sorted uint16 array or 8 KB of packed bits}."""

    def __init__(self, containers: dict[int, np.ndarray]):
        self.containers = containers

    @classmethod
    def of(cls, ordinals: np.ndarray) -> OrdinalSet:
        """From distinct ordinals, in any order."""
        ordinals = np.sort(ordinals)
        high = ordinals // CONTAINER
        cuts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(ordinals) else np.zeros(0, int)
        parts = np.split(ordinals, cuts[1:]) if len(ordinals) else []
        return cls({int(p[0] // CONTAINER): _container((p % CONTAINER).astype(np.uint16)) for p in parts})

    def andnot(self, other: OrdinalSet) -> np.ndarray:
        return self._merge(other, lambda a, b: a & ~b)

    def both(self, other: OrdinalSet) -> np.ndarray:
        return self._merge(other, lambda a, b: a & b)

    def ordinals(self) -> np.ndarray:
        return self._merge(OrdinalSet({}), lambda a, b: a)

    def rank(self, ordinals: np.ndarray) -> np.ndarray:
        """The place of each of these members among the members, from 0: its place in the aligned vector."""
        return np.searchsorted(self.ordinals(), ordinals)

    def _merge(self, other: OrdinalSet, op) -> np.ndarray:
        out = []
        for high in sorted(self.containers):
            bits = op(_bits(self.containers[high]), _bits(other.containers.get(high)))
            out.append(np.flatnonzero(np.unpackbits(bits, bitorder="little")) + high * CONTAINER)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.containers.values())


def _container(offsets: np.ndarray) -> np.ndarray:
    if offsets.nbytes <= CONTAINER // 8:
        return offsets
    return _bits(offsets)


def _bits(container: np.ndarray | None) -> np.ndarray:
    if container is None:
        return np.zeros(CONTAINER // 8, np.uint8)
    if container.dtype == np.uint8:
        return container
    flags = np.zeros(CONTAINER, np.uint8)
    flags[container] = 1
    return np.packbits(flags, bitorder="little")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


ORDINAL_SCHEMA = "key string, bucket int, ordinal long"


def _numbered(keys: pa.Array, known_keys: pa.Array, known_ordinals: np.ndarray) -> np.ndarray:
    """The ordinals of distinct, sorted keys: the known ones, and for the others the numbers behind the largest of them."""
    at = pc.index_in(keys, value_set=known_keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.where(at >= 0, known_ordinals[at] if len(known_ordinals) else -1, -1)
    new = out < 0
    out[new] = (int(known_ordinals.max()) if len(known_ordinals) else -1) + 1 + np.arange(new.sum())
    return out


def _distinct(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    return table["key"].combine_chunks(), table["ordinal"].to_numpy().astype(np.int64)


def _number_bucket(rows: pa.Table, known: pa.Table) -> pa.Table:
    known_keys, ordinals = _distinct(known)
    keys = pc.unique(pa.chunked_array([*rows["key"].chunks, known_keys], pa.string())).sort()
    bucket = (rows if rows.num_rows else known)["bucket"][0].as_py()
    return pa.table({"key": keys, "bucket": pa.array([bucket] * len(keys), pa.int32()), "ordinal": _numbered(keys, known_keys, ordinals)})


def key_ordinals(keys: DataFrame, buckets: int, known: DataFrame | None = None) -> DataFrame:
    """(key, bucket, ordinal) of every distinct non-null key; keys of `known`, of as many buckets, keep their ordinals, also those that keys lacks."""
    keys = keys.select("key").where(F.col("key").isNotNull()).distinct().withColumn("bucket", bucket_of(buckets))
    known = keys.sparkSession.createDataFrame([], ORDINAL_SCHEMA) if known is None else known.select("key", "bucket", "ordinal")
    return keys.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_number_bucket, ORDINAL_SCHEMA)


def latest_rows(rows: DataFrame, key: Column, day: str, value: Column, order: Column, ties: list[Column] = ()) -> DataFrame:
    """One row a key and snapshot, the last delivered: (key, day, value). Rows without key or day are left out."""
    picked = rows.select(key.alias("key"), F.col(day).alias("day"), value.alias("value"), F.struct(order.alias("o"), *[t.alias(f"t{i}") for i, t in enumerate(ties)], value.alias("v")).alias("order"))
    picked = picked.where(F.col("key").isNotNull() & F.col("day").isNotNull())
    return picked.groupBy("key", "day").agg(F.max_by(F.struct("value"), "order").alias("last")).select("key", "day", "last.value")


def _changes(decode, next_day, before: tuple[OrdinalSet, pa.Array], after: tuple[OrdinalSet, pa.Array]):
    added, removed, kept = after[0].andnot(before[0]), before[0].andnot(after[0]), after[0].both(before[0])
    old, new = before[1].take(pa.array(before[0].rank(kept))), after[1].take(pa.array(after[0].rank(kept)))
    same = pc.or_(pc.fill_null(pc.equal(old, new), False), pc.and_(pc.is_null(old), pc.is_null(new)))
    changed = kept[~same.to_numpy(zero_copy_only=False)] if len(kept) else kept
    for name, ordinals in (("added", added), ("removed", removed), ("changed", changed)):
        if len(ordinals):
            yield decode(ordinals), next_day, name


def _diff_bucket(data: pa.Table, known: pa.Table) -> pa.Table:
    """All snapshots of one bucket: columns key, value, day, no (of the snapshot), next_day; known: the ordinals of keys."""
    if not data.num_rows:
        return pa.table({"rec_key": pa.array([], pa.string()), "snapshot_date": pa.array([], pa.date32()), "change": pa.array([], pa.string())})
    data = data.combine_chunks()
    value = data["value"].combine_chunks()
    known_keys, ordinals = _distinct(known)
    keys = pc.unique(data["key"]).sort()
    numbers = _numbered(keys, known_keys, ordinals)
    ordinal = numbers[pc.index_in(data["key"], value_set=keys).to_numpy()]
    order = np.argsort(numbers)
    members, keys = numbers[order], keys.take(pa.array(order))
    number, days = data["no"].to_numpy(), data["next_day"]
    own = data["day"]
    snaps, day_of, next_of = {}, {}, {}

    def decode(ordinals: np.ndarray) -> pa.Array:
        return keys.take(pa.array(np.searchsorted(members, ordinals)))

    for no in np.unique(number):
        rows = np.flatnonzero(number == no)
        rows = rows[np.argsort(ordinal[rows], kind="stable")]
        snaps[no] = OrdinalSet.of(ordinal[rows]), value.take(pa.array(rows))
        day_of[no], next_of[no] = own[int(rows[0])].as_py(), days[int(rows[0])].as_py()
    none = OrdinalSet({}), pa.array([], value.type)
    out: list[tuple[pa.Array, object, str]] = []
    for no in sorted(snaps):
        if no > 1:
            if no - 1 in snaps:
                out += _changes(decode, day_of[no], snaps[no - 1], snaps[no])
            else:
                out += _changes(decode, day_of[no], none, snaps[no])
        if no + 1 not in snaps and next_of[no] is not None:
            out += _changes(decode, next_of[no], snaps[no], none)
    return pa.table(
        {
            "rec_key": pa.chunked_array([k.cast(pa.string()) for k, _, _ in out], pa.string()),
            "snapshot_date": pa.array([d for k, d, _ in out for _ in range(len(k))], pa.date32()),
            "change": pa.array([c for k, _, c in out for _ in range(len(k))], pa.string()),
        }
    )


def snapshot_changes(rows: DataFrame, all_days: DataFrame, buckets: int, known: DataFrame | None = None) -> DataFrame:
    """Differences of consecutive snapshots as (rec_key, snapshot_date, change).

    rows: (key STRING, day DATE, value STRING), one row a key and day, as of latest_rows. all_days: (day), the days
    of all snapshots, also of those that hold none of the rows; repeated and null days count once or not at all.
    The first snapshot gives nothing; a null value equals null only; empty tables give an empty result. known: ordinals
    of key_ordinals, of as many buckets; keys that it lacks are numbered behind them.
    """
    order = W.orderBy("day")
    days = all_days.select("day").where(F.col("day").isNotNull()).distinct()
    days = days.select("day", F.row_number().over(order).alias("no"), F.lead("day").over(order).alias("next_day"))
    # A join by day would gather each snapshot in one task; a DATE has a bounded number of values, deliveries far fewer.
    rows = rows.select("key", "day", "value").join(F.broadcast(days), "day").withColumn("bucket", bucket_of(buckets))
    known = rows.sparkSession.createDataFrame([], ORDINAL_SCHEMA) if known is None else known.select("key", "bucket", "ordinal")
    return rows.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_diff_bucket, DIFF_SCHEMA)


def bucket_count(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets so that one holds about bucket_rows rows; counts the rows (Parquet footers suffice for a plain scan)."""
    return max(12, -(-rows.count() // bucket_rows))
