"""Time expressions. Sessions run in UTC; local days follow the offset that holds at each row's own time."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions.text import strip


def resolve_zone(name: str | None) -> str:
    """The name if it is a time zone, else UTC. Checked on the driver."""
    try:
        return str(ZoneInfo(name or ""))
    except (KeyError, ValueError, OSError):
        return "UTC"


def local_day_start(ts: Column, zone: str) -> Column:
    """The UTC time at which the local day of ``ts`` began."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def local_day_start_after(ts: Column, zone: str, days: int) -> Column:
    """The UTC time of the local midnight ``days`` days after the local day of ``ts``."""
    day = F.date_add(F.to_date(F.from_utc_timestamp(ts, zone)), days)
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def local_date_key(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def month_bounds(month: Column) -> tuple[Column, Column]:
    """First moment of a YYYY-MM month and of the next; null for any other spelling."""
    start = F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_timestamp(F.concat(month, F.lit("-01")), "yyyy-MM-dd"))
    return start, F.add_months(start, 1).cast("timestamp")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: digits, or an HTTP date (not below 0); null for anything else."""
    v = strip(value)
    when = F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    delta = F.when(when.isNotNull(), F.greatest(F.unix_timestamp(when) - F.unix_timestamp(now), F.lit(0)))
    return F.when(v.rlike(r"^\d+$"), v.cast("long")).otherwise(delta)


def parse_time(value: Column) -> Column:
    """Tolerant reading of ISO times with or without zone, blank-separated times and plain dates."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(strip(value), F.lit(f)) for f in formats])


def retry_delay_ms(attempt: Column, server_seconds: Column, draw: Column) -> Column:
    """A server's wait between 0 and under 60 s, else 2^attempt seconds times 0.5 to 1.5 (``draw`` is in [0, 1))."""
    own = F.pow(F.lit(2.0), attempt) * (F.lit(0.5) + draw) * 1000
    return F.when((server_seconds >= 0) & (server_seconds < 60), server_seconds * 1000).otherwise(own)
