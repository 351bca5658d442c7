"""The version ledger: pure functions from ledger and incoming versions to the next ledger.

A ledger row is a version of a unit (law_id, article_no, paragraph_no) in force over [valid_from, valid_to). Parquet
has no row updates, so every operator returns the whole next state; changefeed.publish() makes it the one in force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexstrata.functions.temporal import in_force

KEY = ["law_id", "article_no", "paragraph_no"]


def same_key(a: str, b: str, keys: list[str] = KEY) -> Column:
    """Null-safe equality of all key parts; Spark plans it as an equi-join."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def open_rows(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("valid_to").isNull())


def derive_ledger(versions: DataFrame, keys: list[str] = KEY, order: str = "valid_from", content: str = "content_hash") -> DataFrame:
    """valid_to from the next version's start; a version equal to the one before it is dropped. One row a key and start is required (see history.counting_versions)."""
    by_key = W.partitionBy(*keys).orderBy(order)
    before = F.lag(F.struct(content)).over(by_key)
    kept = versions.withColumn("__fresh", before.isNull() | ~before[content].eqNullSafe(F.col(content))).where("__fresh").drop("__fresh")
    return kept.withColumn("valid_to", F.lead(order).over(by_key))


def reconcile(opened: DataFrame, incoming: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Incoming versions (keys, valid_from, content_hash) against the open rows: (keys, new_from, old_from, status).

    added: nothing open; same: equal content; stale: older than the open row; corrected: same start, other content;
    amended: later start. Both sides must have one row a key.
    """
    joined = incoming.alias("n").join(opened.alias("o"), same_key("n", "o", keys), "left")
    new, old = F.col("n.valid_from"), F.col("o.valid_from")
    status = (
        F.when(old.isNull(), "added").when(F.col("n.content_hash") == F.col("o.content_hash"), "same").when(new < old, "stale").when(new == old, "corrected").otherwise("amended")
    )
    return joined.select(*[F.col(f"n.{k}").alias(k) for k in keys], new.alias("new_from"), old.alias("old_from"), status.alias("status"))


def removed_units(opened: DataFrame, incoming: DataFrame, effective: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Open rows of the laws in `effective` (law_id, effective_on) that the new version lacks: (keys, valid_from, closes_on, conflict).

    A row that starts on or after that day can't be closed there; it is reported as a conflict.
    """
    gone = opened.alias("o").join(incoming.select(*keys).distinct().alias("n"), same_key("o", "n", keys), "left_anti")
    out = gone.join(effective.select("law_id", "effective_on"), "law_id")
    return out.select(*keys, "valid_from", F.col("effective_on").alias("closes_on"), (F.col("valid_from") >= F.col("effective_on")).alias("conflict"))


def apply_version(ledger: DataFrame, incoming: DataFrame, law_id: str, effective: Column, repeal: bool = False) -> DataFrame:
    """apply_versions for one new version of one law."""
    told = ledger.sparkSession.range(1).select(F.lit(law_id).alias("law_id"), effective.alias("effective_on"), F.lit(repeal).alias("repeal"))
    return apply_versions(ledger, incoming, told)


def apply_versions(ledger: DataFrame, incoming: DataFrame, effective: DataFrame) -> DataFrame:
    """The ledger after one new version of each law in effective (law_id, effective_on, repeal): rows of incoming (KEY, title, content, content_hash, version_mst, valid_from; those of the ledger's columns that it has).

    Amended rows close at the new row's start, missing ones at the law's effective day (not if they start then or later),
    corrections replace content in place, stale and equal rows change nothing. A repeal closes all open rows of the law, whatever comes in.
    New rows aren't current until promoted; their id is null until assign_ids(). One row a law in effective, one a key among incoming and open rows.
    """
    told = effective.select("law_id", "effective_on", F.coalesce("repeal", F.lit(False)).alias("__repeal"))
    rows = ledger.join(told, "law_id", "left")
    is_open = F.col("effective_on").isNotNull() & F.col("valid_to").isNull()
    others = rows.where(~is_open).select(*ledger.columns)
    body = [c for c in ("title", "content", "content_hash", "version_mst") if c in ledger.columns]
    new = incoming.join(told.where(~F.col("__repeal")).select("law_id"), "law_id", "left_semi").select(*KEY, F.struct("valid_from", *body).alias("__new")).alias("n")
    met = rows.where(is_open).alias("o").join(new, same_key("o", "n"), "full_outer")
    fresh, old_from = F.col("n.__new"), F.col("o.valid_from")
    same = F.col("o.content_hash") == fresh["content_hash"]
    corrected = fresh.isNotNull() & old_from.isNotNull() & ~same & (fresh["valid_from"] == old_from)
    amended = fresh.isNotNull() & old_from.isNotNull() & ~same & (fresh["valid_from"] > old_from)
    gone = fresh.isNull() & (old_from < F.col("o.effective_on"))

    def field(c: str, value: Column) -> Column:
        return value.cast(ledger.schema[c].dataType).alias(c)

    closed = F.struct(*[
        field(c, F.when(amended, fresh["valid_from"]).when(gone, F.col("o.effective_on")) if c == "valid_to" else F.when(corrected, fresh[c]).otherwise(F.col(f"o.{c}")) if c in body else F.col(f"o.{c}"))
        for c in ledger.columns
    ])
    added = F.struct(*[
        field(c, F.col(f"n.{c}") if c in KEY else fresh[c] if c in (*body, "valid_from") else F.lit(False) if c == "is_current" else F.lit(None))
        for c in ledger.columns
    ])
    out = F.when(old_from.isNull(), F.array(added)).when(amended, F.array(closed, added)).otherwise(F.array(closed))
    return others.unionByName(met.select(F.explode(out).alias("r")).select("r.*"))


def status_counts(reconciled: DataFrame) -> DataFrame:
    """(status, n_rows): the counters of a load, of reconcile()'s rows."""
    return reconciled.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


def assign_ids(ledger: DataFrame, order: list[str]) -> DataFrame:
    """Rows without an id get the numbers behind the largest, in a total order within hash buckets and without one global sort.

    Bucket offsets come from one row a bucket (256 at most), so nothing but the new rows is sorted.
    """
    new = ledger.where(F.col("id").isNull()).withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(256)))
    new = new.withColumn("__n", F.row_number().over(W.partitionBy("__b").orderBy(*order)))
    sizes = new.groupBy("__b").agg(F.count(F.lit(1)).alias("__s"))
    offsets = sizes.withColumn("__o", F.coalesce(F.sum("__s").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__b", "__o")
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    given = new.join(offsets, "__b").withColumn("id", last + F.col("__o") + F.col("__n")).drop("__b", "__n", "__o")
    return ledger.where(F.col("id").isNotNull()).unionByName(given)


def promote_counts(ledger: DataFrame, day: Column) -> DataFrame:
    """(demoted, promoted): current rows that ended by the day; rows in force that aren't current."""
    demoted = F.col("is_current") & (F.col("valid_to") <= day)
    return ledger.agg(F.count_if(demoted).alias("demoted"), F.count_if(~F.col("is_current") & in_force(day)).alias("promoted"))


def promote(ledger: DataFrame, day: Column) -> DataFrame:
    """is_current recomputed for the day; idempotent."""
    return ledger.withColumn("is_current", F.coalesce(in_force(day), F.lit(False)))


def upsert_master(stored: DataFrame, incoming: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Incoming rows replace stored ones but for the columns in `kept`, which an existing row keeps; one row a key on both sides."""
    met = stored.alias("s").join(incoming.alias("i"), F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    was, comes = F.col(f"s.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()
    pick = lambda c: F.when(comes & ~(was & F.lit(c in kept)), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))
    return met.select(*[pick(c).alias(c) for c in stored.columns])


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those incoming ones whose key isn't stored, each key once."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti").select(*stored.columns))


def first_position_last_value(feed: DataFrame, keys: list[str], seq: Column, values: list[str]) -> DataFrame:
    """A keyed map filled in order: each key's last values and the sequence of its first entry."""
    return feed.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("__v"), F.min(seq).alias("first_seq")).select(*keys, "__v.*", "first_seq")


def overlap_flags(ledger: DataFrame, keys: list[str] = KEY, row_id: str = "id") -> DataFrame:
    """Rows that begin before an earlier row of their key has ended: (keys, row_id). Empty intervals overlap nothing."""
    far = F.lit("9999-12-31").cast("date")
    rows = ledger.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    w = W.partitionBy(*keys).orderBy("valid_from", row_id).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("__reach", F.max(F.coalesce("valid_to", far)).over(w)).where(F.col("valid_from") < F.col("__reach")).select(*keys, row_id)


def overlap_counts(ledger: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, n_pairs): pairs of overlapping rows a key, counted by a sweep over starts and ends, never by forming the pairs."""
    rows = ledger.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    far = F.lit("9999-12-31").cast("date")
    marks = F.explode(F.array(F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("step")), F.struct(F.coalesce("valid_to", far).alias("at"), F.lit(-1).alias("step"))))
    # Starts and ends of a key on one day are one row before any ordering, so a key's window is as long as its days are many.
    days = rows.select(*keys, marks.alias("m")).groupBy(*keys, "m.at").agg(F.sum(F.when(F.col("m.step") == 1, 1).otherwise(0)).alias("begun"), F.sum(F.when(F.col("m.step") == -1, 1).otherwise(0)).alias("ended"))
    w = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    open_before = F.sum(F.col("begun") - F.col("ended")).over(w) - F.col("begun")
    pairs = F.col("begun") * open_before + F.col("begun") * (F.col("begun") - 1) / 2
    return days.withColumn("p", pairs).groupBy(*keys).agg(F.sum("p").cast("long").alias("n_pairs")).where("n_pairs > 0")


def boundary_hits(periods: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, day, n_hits): versions in force on each day on which a version of the key begins or ends."""
    marks = F.explode(F.array(F.struct(F.col("valid_from").alias("day"), F.lit(1).alias("step")), F.struct(F.col("valid_to").alias("day"), F.lit(-1).alias("step"))))
    days = periods.select(*keys, marks.alias("m")).where(F.col("m.day").isNotNull()).groupBy(*keys, F.col("m.day").alias("day")).agg(F.sum("m.step").alias("step"))
    w = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return days.select(*keys, "day", F.sum("step").over(w).alias("n_hits"))
