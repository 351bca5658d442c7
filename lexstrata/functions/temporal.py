"""The one generator of temporal predicates, and day helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_day(as_of: dt.date | str | None) -> Column:
    """A day as a column: a date, an ISO string (ValueError if it isn't one), or today for None and ''."""
    if as_of is None or as_of == "":
        return F.current_date()
    return F.lit(as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of))


def in_force(day: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """start <= day < end; an open end is null."""
    return (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day))


def day_spine(spark: SparkSession, since: Column, until: Column) -> DataFrame:
    """(day): every day from since to until, both included; none if until is before since."""
    span = F.when(since <= until, F.sequence(since, until, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(span).alias("day"))
