"""Timestamps: tolerant parsing and window arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.text import col, first_present, strip

# Accepted layouts. Optional sections cover the variants with
# and without fraction; XXX is an offset such as +05:30 or Z.
ISO_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
ISO_COMPACT_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d{1,9})?[+-]\d{4}$"
PLAIN_SECONDS = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}([.,]\d{1,9})?$"


def as_timestamp(c: Column | str) -> Column:
    """UTC timestamp of a timestamp or timestamp_ntz column."""
    return col(c).cast("timestamp")


def parse_iso(text: Column) -> Column:
    """Offset timestamps and ``yyyy-MM-dd HH:mm:ss`` in UTC, else NULL.

    Fractions are cut to microseconds, Spark's resolution.
    """
    micro = F.regexp_replace(text, r"[.,](\d{1,6})\d*", ".$1")
    return F.when(text.rlike(ISO_OFFSET) | text.rlike(PLAIN_SECONDS), micro.try_cast("timestamp"))


def parse_event_time(time_created: Column, timestamp: Column, fallback: Column) -> Column:
    """Event time: the first of the two texts that is filled, else ``fallback``."""
    return F.coalesce(parse_iso(first_present(time_created, timestamp)), as_timestamp(fallback))


def parse_scada_time(text: Column, fallback: Column) -> Column:
    """SCADA times additionally allow an offset without a colon."""
    t = strip(text)
    with_colon = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    normal = F.when(t.rlike(ISO_COMPACT_OFFSET), with_colon).otherwise(t)
    return F.coalesce(parse_iso(normal), as_timestamp(fallback))


def migrate_text_time(text: Column, inserted_at: Column) -> Column:
    """Legacy text column to timestamp: anything that does not start like an
    ISO date becomes the insert time."""
    looks_iso = F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.lit(False))
    return F.when(looks_iso, F.coalesce(text.try_cast("timestamp"), inserted_at)).otherwise(inserted_at)


def whole_division(a: Column, b: int) -> Column:
    """Floor of ``a / b`` for whole numbers, exact."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("bigint")


def bucket(ts: Column | str, seconds: int) -> Column:
    """Number of the ``seconds``-wide epoch bucket that holds ``ts``."""
    return whole_division(micros(ts), seconds * 1_000_000)


def bucket_start(number: Column | str, seconds: int) -> Column:
    return F.timestamp_seconds(col(number) * F.lit(seconds))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(as_timestamp(ts))


def iso_text(ts: Column | str) -> Column:
    """Compact ISO text in UTC, fraction kept when there is one."""
    t = as_timestamp(ts)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    fraction = F.rtrim(F.lpad(part.cast("string"), 6, "0"), F.lit("0"))
    return F.when(part == 0, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), fraction, F.lit("Z")))
