"""Days, months and years on disk, refreshed only where their input changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _dated(df: DataFrame) -> DataFrame:
    date = F.date_add(F.to_date(F.lit("1970-01-01")), F.col("day").cast("int"))
    return df.withColumns({"year": F.year(date), "month": F.month(date)})


def _replace(df: DataFrame, path: str, parts: list[str]) -> None:
    """Writes df's partitions in place of the same ones at path; all others keep their files."""
    df.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def refresh(rows: DataFrame, base: str, facts: Callable[[DataFrame], DataFrame], total: Callable[[DataFrame, list[str]], DataFrame]) -> dict[str, int]:
    """Brings base/days, base/months and base/years up to date with rows, which have `day`; says how many of each it wrote.

    A day whose rows' count and digest differ from the stored ones, a new day and a day that has gone are touched: facts()
    makes these days anew out of all of their rows, and total(days, keys) the months and years that they are in. Days are
    folders by year, month and day, so what is not touched is neither computed nor written. facts() and total() give no
    column of the names year, month, day_rows and day_hash. A day without rows becomes one without facts.
    """
    spark = rows.sparkSession
    marks = rows.groupBy("day").agg(F.count(F.lit(1)).alias("day_rows"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])).alias("day_hash"))
    try:
        stored = spark.read.parquet(f"{base}/marks").select("day", F.col("day_rows").alias("n0"), F.col("day_hash").alias("h0"))
    except AnalysisException:  # the first time
        stored = marks.limit(0).select("day", F.col("day_rows").alias("n0"), F.col("day_hash").alias("h0"))
    met = marks.join(stored, "day", "full")
    # One small row a day; the list is of days alone.
    touched = [r.day for r in met.where(~(F.col("day_rows").eqNullSafe(F.col("n0")) & F.col("day_hash").eqNullSafe(F.col("h0")))).select("day").collect()]
    if not touched:
        return {"days": 0, "months": 0, "years": 0}
    days = spark.createDataFrame([(d,) for d in touched], "day long")
    own = rows.join(F.broadcast(days), "day", "left_semi") if len(touched) < 10_000 else rows.join(days, "day", "left_semi")
    _replace(_dated(facts(own)), f"{base}/days", ["year", "month", "day"])
    dates = _dated(days)
    months, years = [(r.year, r.month) for r in dates.select("year", "month").distinct().collect()], sorted({r.year for r in dates.select("year").distinct().collect()})
    whole = spark.read.parquet(f"{base}/days")
    in_months = F.struct("year", "month").isin(*[F.struct(F.lit(y), F.lit(m)) for y, m in months])
    in_years = F.col("year").isin(*years)
    _replace(total(whole.where(in_years & in_months), ["year", "month"]), f"{base}/months", ["year", "month"])
    _replace(total(whole.where(in_years), ["year"]), f"{base}/years", ["year"])
    # The marks come last: what fails before is touched again.
    _replace(_dated(days.join(marks, "day", "left").select("day", F.coalesce("day_rows", F.lit(0)).alias("day_rows"), F.coalesce("day_hash", F.lit(0)).alias("day_hash"))), f"{base}/marks", ["year", "month", "day"])
    return {"days": len(touched), "months": len(months), "years": len(years)}
