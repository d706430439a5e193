"""Algebra of half-open intervals [start_us, end_us): the core that the activity operators build on.

`keys` name the columns within which intervals relate to one another, a device and a day as a rule. Every window here
is partitioned by them, so one exchange serves a chain of these operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.time import DAY, HOUR, day_number, day_start

ORDER = ("start_us", "end_us", "id")


def ordered(keys: list[str], *by: str | Column):
    return Window.partitionBy(*keys).orderBy(*(by or ORDER))


def with_same(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of `other`, which has one row for each value of keys; a null key is a key like any."""
    named = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True))
    return rows.join(named, same).drop(*[f"__{k}" for k in keys])


def clip(df: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """Intervals cut to [low, high); empty ones go."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    cut = df.withColumns({"start_us": F.greatest("start_us", low), "end_us": F.least("end_us", high)})
    return cut.where("end_us > start_us")


def cut(df: DataFrame, step_us: int, into: str = "slot") -> DataFrame:
    """Each interval once for each slot of step_us that it meets, cut to it; an exclusive end opens no slot."""
    slots = F.sequence(F.floor(F.col("start_us") / step_us), F.floor((F.col("end_us") - 1) / step_us))
    each = df.where("end_us > start_us").withColumn(into, F.explode(slots))
    return each.withColumns({"start_us": F.greatest("start_us", F.col(into) * step_us), "end_us": F.least("end_us", (F.col(into) + 1) * step_us)})


def by_day(df: DataFrame, zone: Column | str | None = None) -> DataFrame:
    """Intervals cut at midnights, with `day` as days since 1970 and `from_us`, the start before cutting.

    `zone` is a column of df or a zone's name; days are then local ones, 23 to 25 hours long where clocks change, and an
    hour that repeats is two. Without it they are UTC days. Cutting first bounds every later partition to one device and
    day, and changes no length.
    """
    told = df.withColumn("from_us", F.col("start_us"))
    if zone is None:
        return cut(told, DAY, "day")
    days = F.sequence(day_number(F.col("start_us"), zone), day_number(F.col("end_us") - 1, zone))
    each = told.where("end_us > start_us").withColumn("day", F.explode(days))
    return clip(each, day_start(F.col("day"), zone), day_start(F.col("day") + 1, zone))


def day_spans(df: DataFrame, keys: list[str], zone: Column | str | None = None) -> DataFrame:
    """The bounds of each day (keys with `day`) that df has, as low_us and high_us: what gaps() takes."""
    day = F.col("day")
    low, high = (day * DAY, (day + 1) * DAY) if zone is None else (day_start(day, zone), day_start(day + 1, zone))
    return df.groupBy(*keys).agg(F.min(low).alias("low_us"), F.max(high).alias("high_us"))


def trim(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Each interval cut at the next one's start, so that no moment belongs to two; empty ones go."""
    following = F.lead("start_us").over(ordered(keys, *(order or ORDER)))
    return df.withColumn("end_us", F.least("end_us", F.coalesce(following, "end_us"))).where("end_us > start_us")


def islands(df: DataFrame, keys: list[str], starts: Column, *order: str, into: str = "island") -> DataFrame:
    """df with a running number that grows by one where `starts` holds."""
    w = ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def _reach(keys: list[str]) -> Column:
    """The latest end of all intervals before, in start order."""
    return F.max("end_us").over(ordered(keys, "start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1))


def merge(df: DataFrame, keys: list[str], gap_us: int = 0) -> DataFrame:
    """The union of intervals as disjoint ones; those that touch, or lie gap_us apart at most, are one."""
    told = df.select(*keys, "start_us", "end_us").withColumn("reach", _reach(keys))
    new = F.col("reach").isNull() | (F.col("start_us") > F.col("reach") + gap_us)
    return islands(told, keys, new, "start_us", "end_us", into="__part").groupBy(*keys, "__part").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("__part")


def merge_days(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """merge() of long histories: by day first, then only what touches midnight meets its neighbours again."""
    parts = merge(by_day(df), [*keys, "day", *more])
    edge = (F.pmod("start_us", F.lit(DAY)) == 0) | (F.pmod("end_us", F.lit(DAY)) == 0)
    cols = [*keys, *more, "start_us", "end_us"]
    return parts.where(~edge).select(*cols).unionByName(merge(parts.where(edge), [*keys, *more]).select(*cols))


def union_us(df: DataFrame, keys: list[str], into: str = "union_us") -> DataFrame:
    """Length of the union by keys: each row adds what lies beyond all before it, so one window is enough."""
    told = df.select(*keys, "start_us", "end_us").withColumn("reach", _reach(keys))
    own = F.greatest(F.lit(0), F.col("end_us") - F.greatest("start_us", F.coalesce("reach", "start_us")))
    return told.groupBy(*keys).agg(F.sum(own).alias(into))


def gaps(df: DataFrame, keys: list[str], least_us: int, bounds: DataFrame) -> DataFrame:
    """Holes of least_us or more between low_us, the intervals and high_us; `bounds` has keys, low_us and high_us.

    A hole is missing data, never idle time. Keys without any interval are one hole.
    """
    edge = bounds.select(*keys, F.col("low_us").alias("start_us"), F.col("low_us").alias("end_us"))
    tail = bounds.select(*keys, F.col("high_us").alias("start_us"), F.col("high_us").alias("end_us"))
    told = df.select(*keys, "start_us", "end_us").unionByName(edge).unionByName(tail).withColumn("reach", _reach(keys))
    return told.where(F.col("start_us") - F.col("reach") >= least_us).select(*keys, F.col("reach").alias("start_us"), F.col("start_us").alias("end_us"))


def _bucketed(df: DataFrame, bucket_us: int) -> DataFrame:
    return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor((F.greatest("end_us", F.col("start_us") + 1) - 1) / bucket_us))))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], bucket_us: int = HOUR) -> DataFrame:
    """Pairs of an interval of a and one of b that overlap, with the overlap as start_us and end_us.

    Both sides are dealt by time bucket, so the join is an equi-join; a pair counts only in the bucket where its overlap
    begins. Other columns of the two sides must have different names.
    """
    left = _bucketed(a.withColumnsRenamed({"start_us": "a_start", "end_us": "a_end"}).withColumns({"start_us": F.col("a_start"), "end_us": F.col("a_end")}), bucket_us).drop("start_us", "end_us")
    right = _bucketed(b.withColumnsRenamed({"start_us": "b_start", "end_us": "b_end"}).withColumns({"start_us": F.col("b_start"), "end_us": F.col("b_end")}), bucket_us).drop("start_us", "end_us")
    met = left.join(right, [*keys, "__b"]).where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    met = met.withColumns({"start_us": F.greatest("a_start", "b_start"), "end_us": F.least("a_end", "b_end")})
    return met.where(F.floor(F.col("start_us") / bucket_us) == F.col("__b")).drop("__b")


def intersect(a: DataFrame, b: DataFrame, keys: list[str], bucket_us: int = HOUR) -> DataFrame:
    """Pairwise intersections of two sets: keys, start_us, end_us."""
    return overlap_join(a.select(*keys, "start_us", "end_us"), b.select(*keys, "start_us", "end_us"), keys, bucket_us).select(*keys, "start_us", "end_us")


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "at_us", bucket_us: int = HOUR, how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them. `how` is inner or left_semi."""
    p = points.withColumn("__b", F.floor(F.col(at) / bucket_us))
    s = _bucketed(spans, bucket_us)
    if how == "left_semi":
        met = p.alias("p").join(s.alias("s"), [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("p.__b") == F.col("s.__b"), F.col(f"p.{at}") >= F.col("s.start_us"), F.col(f"p.{at}") < F.col("s.end_us")], "left_semi")
        return met.drop("__b")
    return p.join(s, [*keys, "__b"]).where((F.col(at) >= F.col("start_us")) & (F.col(at) < F.col("end_us"))).drop("__b")


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint intervals of a (with id) less the union of b: one sweep over boundaries, no join. A may be split."""
    side = lambda df, at, da, db, own: df.select(*keys, F.col(at).alias("t"), F.lit(da).alias("da"), F.lit(db).alias("db"), own.alias("own"))
    none = F.lit(None).cast("long")
    edges = reduce(DataFrame.unionByName, [side(a, "start_us", 1, 0, F.col("id")), side(a, "end_us", -1, 0, none), side(b, "start_us", 0, 1, none), side(b, "end_us", 0, -1, none)])
    at = edges.groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"), F.max("own").alias("own"))
    w = ordered(keys, "t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"in_a": F.sum("da").over(run), "in_b": F.sum("db").over(run), "id": F.last("own", True).over(run), "until": F.lead("t").over(w)})
    parts = at.where("in_a > 0 AND in_b = 0 AND until > t").select(*keys, "id", F.col("t").alias("start_us"), F.col("until").alias("end_us"))
    # Boundaries of a's neighbours inside b's holes cut nothing: touching parts of one interval are one.
    return merge(parts, [*keys, "id"])


def overlap_partition(df: DataFrame, keys: list[str], label: str, bucket_us: int = HOUR) -> DataFrame:
    """Overlapping intervals as disjoint pieces, each with the sorted set of labels there; equal neighbours are one.

    Intervals of one label are merged first, so a piece meets each label once, however many intervals lie over it.
    """
    own = merge(df, [*keys, label])
    times = own.select(*keys, F.explode(F.array("start_us", "end_us")).alias("t")).distinct()
    pieces = times.withColumn("end_us", F.lead("t").over(ordered(keys, "t"))).where("end_us IS NOT NULL").withColumnRenamed("t", "start_us")
    met = overlap_join(pieces, own.select(*keys, "start_us", "end_us", label), keys, bucket_us)
    sets = met.groupBy(*keys, F.col("a_start").alias("start_us"), F.col("a_end").alias("end_us")).agg(F.array_join(F.array_sort(F.collect_set(label)), "+").alias("labels"))
    w = ordered(keys, "start_us")
    new = F.coalesce((F.lag("end_us").over(w) != F.col("start_us")) | (F.lag("labels").over(w) != F.col("labels")), F.lit(True))
    joined = islands(sets.withColumn("new", new), keys, F.col("new"), "start_us")
    return joined.groupBy(*keys, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.first("labels").alias("labels")).drop("island")


def half_hours(df: DataFrame, keys: list[str]) -> DataFrame:
    """The UTC half hours that intervals occupy; a repeated local hour stays two."""
    return cut(df.select(*keys, "start_us", "end_us"), HOUR // 2, "half_hour").select(*keys, "half_hour").distinct()
