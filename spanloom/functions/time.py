"""Time as microseconds since 1970 in UTC; zones only at the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND


def micros(ts: str) -> Column:
    """Microseconds of a TIMESTAMP_NTZ column that is in UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def local_us(us: Column, zone: Column | str) -> Column:
    """A zone's clock as microseconds since its 1970: what the wall shows at an instant, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def day_number(us: Column, zone: Column | str) -> Column:
    """Days since 1970 of an instant's local date."""
    return F.floor(local_us(us, zone) / DAY)


def day_start(day: Column, zone: Column | str) -> Column:
    """The first instant of a local day, given as days since 1970: the first of two where midnight comes twice, and the end
    of the gap where it never comes."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros((day * DAY).cast("long")), zone))


def local_bounds(day: Column, zone: Column | str) -> tuple[Column, Column]:
    """First and one past the last microsecond of a local day (a date): 23, 24 or 25 hours apart as a rule."""
    n = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    return day_start(n, zone), day_start(n + 1, zone)


def local_day(us: Column, zone: Column | str) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(us, zone).cast("int"))


def temporal_key(df: DataFrame, us: str, zone: str) -> DataFrame:
    """df with local date, hour, half hour and UTC offset in minutes, so that a repeated local hour has two keys."""
    local = F.from_utc_timestamp(F.timestamp_micros(F.col(us)), zone)
    return df.withColumns(
        {
            "local_date": F.to_date(local),
            "local_hour": F.hour(local).cast("long"),
            "half_hour": F.floor(F.minute(local) / 30).cast("long"),
            "offset_min": ((F.unix_micros(local) - F.col(us)) / MINUTE).cast("long"),
        }
    )
