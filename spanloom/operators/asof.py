"""As-of joins: the latest row at or before a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.time import DAY


def asof(points: DataFrame, rows: DataFrame, keys: list[str], at: str, take: list[str], tie: str = "id") -> DataFrame:
    """points with `take` and `match_us` of the latest row whose start_us is at or before `at`; null without any.

    Both sides go through one window sorted by time, by keys and UTC day, and without a join. Into each day comes one row
    more: the last one of the days before, found over one row a day, so that no task has a key's whole history.
    """
    fields = F.struct(F.col("start_us").alias("match_us"), *take)
    kind = rows.select(fields.alias("x")).schema["x"].dataType
    days = [*keys, "__day"]
    left = points.withColumns({"__t": F.col(at), "__side": F.lit(1), "__tie": F.lit(0).cast("long"), "__m": F.lit(None).cast(kind)}).withColumn("__day", F.floor(F.col("__t") / DAY))
    right = rows.select(*keys, F.col("start_us").alias("__t"), F.lit(0).alias("__side"), F.col(tie).cast("long").alias("__tie"), fields.alias("__m")).withColumn("__day", F.floor(F.col("__t") / DAY))
    last = right.groupBy(*days).agg(F.max_by("__m", F.struct("__t", "__tie")).alias("__m")).unionByName(left.select(*days).distinct(), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.groupBy(*days).agg(F.first("__m", True).alias("__m")).select(*days, F.last("__m", True).over(before).alias("__m")).where("__m IS NOT NULL")
    carried = carried.withColumns({"__t": F.col("__day") * DAY - 1, "__side": F.lit(0), "__tie": F.lit(0).cast("long")})
    both = left.unionByName(right.unionByName(carried), allowMissingColumns=True)
    w = Window.partitionBy(*days).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__m", F.last("__m", True).over(w)).where("__side = 1")
    return found.select(*points.columns, F.col("__m.match_us").alias("match_us"), *[F.col(f"__m.{c}").alias(c) for c in take])


def within(at: str, tolerance_us: int, value: str) -> Column:
    """A matched value, or null where the match is older than the tolerance."""
    return F.when(F.col(at) - F.col("match_us") <= tolerance_us, F.col(value))


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], at: str, radius_us: int, take: str, same: str | None = None) -> DataFrame:
    """points with `take` of the nearest mark (at mark_us, with ord) within the radius, the first listed on a tie; else null.

    `same` names a column of both sides that must agree where both know it. Points that repeat are one.
    """
    bucket = 2 * radius_us
    p = points.withColumn("__b", F.floor(F.col(at) / bucket))
    m = marks.select(*keys, "mark_us", "ord", take, *([F.col(same).alias("__same")] if same else []))
    m = m.withColumn("__b", F.explode(F.array(*[F.floor((F.col("mark_us") + d) / bucket) for d in (-radius_us, radius_us)]))).distinct()
    met = p.join(m, [*keys, "__b"], "left").withColumn("__d", F.abs(F.col(at) - F.col("mark_us")))
    fits = F.col("__d") <= radius_us
    if same:
        fits = fits & F.coalesce(F.col("__same") == F.col(same), F.lit(True))
    close = F.when(fits, F.struct("__d", "ord", F.col(take).alias("v")))
    return met.groupBy(*points.columns).agg(F.min(close).getField("v").alias(take))
