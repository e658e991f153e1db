"""Time buckets, and zone-free timestamps as instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_bucket(ts: Column, seconds: int = 5 * 86_400) -> Column:
    """The start of the epoch-aligned bucket of an instant; times before the epoch go to the bucket nearer it."""
    return F.timestamp_seconds(F.unix_seconds(ts) - F.unix_seconds(ts) % seconds)


def instant(ntz: Column) -> Column:
    """A timestamp without zone read as UTC, whatever the session's zone."""
    return F.to_timestamp(F.concat(ntz.cast("string"), F.lit("Z")))


def zone_free(ts: Column) -> Column:
    """An instant's UTC wall-clock time as a timestamp without zone, whatever the session's zone."""
    seconds = F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)
    return F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def whole_minute(ts: Column) -> Column:
    return F.unix_micros(ts) % 60_000_000 == 0


def epoch_minutes(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(60_000_000)).cast("long")
