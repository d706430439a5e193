"""Days of 23 and 25 hours, midnights that never come, the repeated hour, and zones of half hours."""

from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from spanloom.functions.time import DAY, HOUR, MINUTE, day_number, day_start
from spanloom.operators import activity as A
from spanloom.operators import interval as I


def us(text, zone="UTC", fold=0):
    return int(datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone), fold=fold).timestamp() * 1_000_000)


def samples(spark, rows):
    return spark.createDataFrame([(i, dev, s, e - s, state, "app", "w", zone) for i, (dev, s, e, state, zone) in enumerate(rows)], "id long, device long, start_us long, dur_us long, state string, app string, win string, zone string")


@pytest.mark.parametrize("session", ["UTC", "Asia/Tokyo"])
def test_days_have_the_hours_of_their_zone(spark, session):
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        rows = [("America/Chicago", "2026-03-08", 23), ("America/Chicago", "2026-11-01", 25), ("America/Chicago", "2026-07-01", 24), ("Asia/Kolkata", "2026-03-08", 24), ("Africa/Cairo", "2024-04-26", 23), ("America/Havana", "2024-11-03", 25)]
        df = spark.createDataFrame([(z, us(f"{d} 12:00", z), h) for z, d, h in rows], "zone string, us long, hours int")
        n, zone = day_number(F.col("us"), F.col("zone")), F.col("zone")
        got = df.select("hours", n.alias("n"), day_start(n, zone).alias("low"), day_start(n + 1, zone).alias("high"), "us").collect()
        for g, (z, d, h) in zip(got, rows, strict=True):
            assert g.high - g.low == h * HOUR and g.low <= g.us < g.high and g.n == us(d) // DAY, (z, d)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_by_day_cuts_at_local_midnights_and_keeps_lengths(spark):
    zone = "America/Chicago"
    a, b = us("2026-10-31 22:00", zone), us("2026-11-02 01:00", zone)
    got = I.by_day(spark.createDataFrame([(a, b, zone)], "start_us long, end_us long, zone string"), F.col("zone")).orderBy("start_us").collect()
    assert [(g.end_us - g.start_us) // HOUR for g in got] == [2, 25, 1] and got[0].start_us == a and got[-1].end_us == b
    assert all(x.end_us == y.start_us for x, y in zip(got, got[1:], strict=False)) and {g.from_us for g in got} == {a}


def test_a_day_that_never_was_has_no_piece(spark):
    zone = "Pacific/Apia"  # 30 December 2011 was left out
    got = I.by_day(spark.createDataFrame([(us("2011-12-29 22:00", zone), us("2011-12-31 02:00", zone))], "start_us long, end_us long"), zone).orderBy("start_us").collect()
    assert [(g.day - us("2011-12-29") // DAY, (g.end_us - g.start_us) // HOUR) for g in got] == [(0, 2), (2, 2)]


def test_repeated_hour_counts_as_two(spark):
    zone = "America/Chicago"
    first, second = us("2026-11-01 01:30", zone, 0), us("2026-11-01 01:30", zone, 1)
    assert second - first == HOUR
    runs = A.observed_runs(samples(spark, [(1, first, second, "active", zone)]), zone=F.col("zone"))
    assert runs.agg(F.sum(F.col("end_us") - F.col("start_us"))).first()[0] == HOUR
    hours = {r.hour: r.us for r in A.hour_profile(runs, F.col("zone")).collect()}
    assert hours == {1: HOUR}
    total = A.state_totals(runs, F.col("zone")).first()
    assert (total.active_us, total.unobserved_us) == (HOUR, 24 * HOUR)


def test_gaps_reach_to_local_midnights(spark):
    zone = "America/Chicago"
    low, high = us("2026-03-08 00:00", zone), us("2026-03-09 00:00", zone)
    runs = A.observed_runs(samples(spark, [(1, low + 2 * HOUR, low + 3 * HOUR, "idle", zone)]), zone=F.col("zone"))
    got = sorted((g.start_us - low, g.end_us - low) for g in I.gaps(runs, A.KEYS, MINUTE, I.day_spans(runs, A.KEYS, F.col("zone"))).collect())
    assert got == [(0, 2 * HOUR), (3 * HOUR, 23 * HOUR)] and high - low == 23 * HOUR


def test_all_hours_are_there_and_phones_count_once(spark):
    zone = "Asia/Kolkata"
    nine = us("2026-05-05 09:00", zone)
    runs = A.observed_runs(samples(spark, [(1, nine + 30 * MINUTE, nine + 90 * MINUTE, "active", zone)]), zone=F.col("zone"))
    phone = spark.createDataFrame([(1, nine, nine + 40 * MINUTE, zone), (1, nine + 20 * MINUTE, nine + 70 * MINUTE, zone), (2, nine, nine + MINUTE, zone)], "device long, start_us long, end_us long, zone string")
    got = {(g.device, g.hour): g for g in A.hours_of_day(runs, phone, F.col("zone")).collect()}
    assert len(got) == 48
    assert (got[1, 9].active_us, got[1, 10].active_us, got[1, 9].phone_us, got[1, 10].phone_us) == (30 * MINUTE, 30 * MINUTE, 60 * MINUTE, 10 * MINUTE)
    assert sum(g.active_us + g.phone_us for g in got.values()) == 60 * MINUTE + 71 * MINUTE and got[2, 9].phone_us == MINUTE and got[2, 10].phone_us == 0
