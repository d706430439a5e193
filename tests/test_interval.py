import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.time import DAY, HOUR, MINUTE, SECOND, local_bounds, local_day, temporal_key
from spanloom.operators import interval as I


def spans(spark, rows):
    return spark.createDataFrame([(i, "d", s, e) for i, (s, e) in enumerate(rows)], "id long, device string, start_us long, end_us long")


def pairs(df):
    return sorted((r.start_us, r.end_us) for r in df.collect())


def test_union_counts_overlap_once(spark):
    # -5..5 and 3..13 minutes, clipped at 0: 13 minutes of union, 2 of overlap.
    clipped = I.clip(spans(spark, [(-5 * MINUTE, 5 * MINUTE), (3 * MINUTE, 13 * MINUTE)]), 0, DAY)
    assert I.union_us(clipped, ["device"]).first().union_us == 780 * SECOND
    assert clipped.agg(F.sum(F.col("end_us") - F.col("start_us"))).first()[0] - 780 * SECOND == 120 * SECOND


def test_merge_joins_touching(spark):
    assert pairs(I.merge(spans(spark, [(0, 5), (5, 9), (12, 13), (1, 2)]), ["device"])) == [(0, 9), (12, 13)]


def test_trim_gives_each_moment_to_one(spark):
    assert pairs(I.trim(spans(spark, [(0, 10), (4, 8), (4, 6)]), ["device"])) == [(0, 4), (4, 8)] or pairs(I.trim(spans(spark, [(0, 10), (4, 8), (4, 6)]), ["device"])) == [(0, 4), (4, 6)]


def test_cut_has_exclusive_end(spark):
    got = sorted((r.slot, r.start_us, r.end_us) for r in I.cut(spans(spark, [(50, 200)]), 100).collect())
    assert got == [(0, 50, 100), (1, 100, 200)]


def test_gaps_need_a_minute_and_see_both_ends(spark):
    bounds = spark.createDataFrame([("d", 0, 1000 * SECOND)], "device string, low_us long, high_us long")
    got = I.gaps(spans(spark, [(60 * SECOND, 100 * SECOND), (130 * SECOND, 700 * SECOND)]), ["device"], 60 * SECOND, bounds)
    assert pairs(got) == [(0, 60 * SECOND), (700 * SECOND, 1000 * SECOND)]


def test_gap_of_a_key_without_data(spark):
    bounds = spark.createDataFrame([("x", 0, HOUR)], "device string, low_us long, high_us long")
    assert pairs(I.gaps(spans(spark, []), ["device"], MINUTE, bounds)) == [(0, HOUR)]


def test_subtract_splits(spark):
    a, b = spans(spark, [(0, 100), (100, 150)]), spans(spark, [(20, 30), (25, 40), (90, 110)])
    assert pairs(I.subtract(a, b, ["device"])) == [(0, 20), (40, 90), (110, 150)]


def test_overlap_partition(spark):
    df = spark.createDataFrame([("d", 0, 10, "a"), ("d", 5, 15, "b"), ("d", 15, 20, "b")], "device string, start_us long, end_us long, app string")
    got = sorted((r.start_us, r.end_us, r.labels) for r in I.overlap_partition(df, ["device"], "app").collect())
    assert got == [(0, 5, "a"), (5, 10, "a+b"), (10, 20, "b")]


@pytest.mark.parametrize("seed", range(3))
def test_algebra_on_random_intervals(spark, seed):
    r = random.Random(seed)
    make = lambda: [(s, s + r.randint(1, 60)) for s in (r.randint(0, 500) for _ in range(30))]
    x, y = make(), make()
    a, b = I.merge(spans(spark, x), ["device"]).withColumn("id", F.col("start_us")), spans(spark, y)
    sx = {t for s, e in x for t in range(s, e)}
    sy = {t for s, e in y for t in range(s, e)}
    points = lambda df: [t for s, e in pairs(df) for t in range(s, e)]
    assert sorted(points(I.subtract(a, b, ["device"]))) == sorted(sx - sy)
    assert sorted(points(I.intersect(a, I.merge(b, ["device"]), ["device"], 50))) == sorted(sx & sy)
    assert I.union_us(spans(spark, x), ["device"]).first().union_us == len(sx)
    assert sum(e - s for s, e in pairs(I.cut(a, 64))) == len(sx)


def test_empty_tables(spark):
    none = spans(spark, [])
    for df in (I.merge(none, ["device"]), I.union_us(none, ["device"]), I.trim(none, ["device"]), I.subtract(none, none, ["device"]), I.intersect(none, none, ["device"])):
        assert df.count() == 0


@pytest.mark.parametrize("day,hours", [("2026-03-08", 23), ("2026-09-29", 24), ("2026-11-01", 25)])
def test_local_days_have_their_hours(spark, day, hours):
    low, high = local_bounds(F.to_date(F.lit(day)), "America/Chicago")
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert r.b - r.a == hours * HOUR
    assert str(spark.range(1).select(local_day(F.lit(r.a), "America/Chicago")).first()[0]) == day


def test_repeated_hour_has_two_keys(spark):
    # 2026-11-01 06:30 and 07:30 UTC are both 01:30 in Chicago.
    df = spark.createDataFrame([(1_793_514_600_000_000,), (1_793_518_200_000_000,)], "us long")
    rows = temporal_key(df, "us", "America/Chicago").collect()
    assert rows[0].local_hour == rows[1].local_hour == 1 and rows[0].offset_min != rows[1].offset_min
