"""The ledger laid out for reading by day: folders by day and source, buckets by device, sorted in time.

A scan of a day and its look-back reads their folders alone, and windows, joins and sums by device and day begin without an
exchange, since a bucket has all of a device's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.time import DAY, HOUR


def store(rows: DataFrame, name: str, path: str, buckets: int, source: str = "source") -> None:
    """Writes rows (device, start_us, a source, more) as table `name` at path; their UTC day is added as `on_day`."""
    told = rows.withColumn("on_day", F.floor(F.col("start_us") / DAY))
    told = told.repartition(buckets, "device").sortWithinPartitions("on_day", source, "device", "start_us")
    told.write.mode("overwrite").format("parquet").option("path", path).partitionBy("on_day", source).bucketBy(buckets, "device").sortBy("device", "start_us").saveAsTable(name)


def read_days(spark: SparkSession, name: str, low_us: int, high_us: int, look_back_us: int = 6 * HOUR) -> DataFrame:
    """Rows that start from look_back_us before low_us until high_us; only the folders of these days are read."""
    low = low_us - look_back_us
    inside = F.col("on_day").between(low // DAY, (high_us - 1) // DAY) & (F.col("start_us") >= low) & (F.col("start_us") < high_us)
    return spark.table(name).where(inside).drop("on_day")
