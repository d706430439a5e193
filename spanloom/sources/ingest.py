"""Bringing rows in: content-addressed appends, upserts on plain Parquet, and the rules of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import is_work_path
from spanloom.functions.time import DAY
from spanloom.sources.scratch import written


def with_id(rows: DataFrame, cols: list[str]) -> DataFrame:
    """rows with row_id, a digest of some columns in a fixed order."""
    return rows.withColumn("row_id", F.substr(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256), F.lit(1), F.lit(16)))


def append_new(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Rows to append: one for each id that the target does not have yet."""
    return rows.dropDuplicates(["row_id"]).join(target.select("row_id"), "row_id", "left_anti")


def empty_annotations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path long, model long, n long, status string, attempts long")


def upsert_annotations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new annotations by (path, model): the latest status, attempts added up. One shuffle, no join."""
    both = stored.select("path", "model", "n", "status", "attempts").unionByName(new.select("path", "model", "n", "status", F.lit(1).cast("long").alias("attempts")))
    return both.groupBy("path", "model").agg(F.max_by("status", F.struct("n", "status")).alias("status"), F.max("n").alias("n"), F.sum("attempts").alias("attempts"))


def upsert_descriptions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new descriptions by (path, model, prompt): the last written row (at_us, n) replaces status, attempts and
    elapsed_s as it has them. Of rows that share at_us and n the one with the greatest attempts, elapsed_s and status stays,
    however rows are dealt out. One shuffle, no join."""
    both = stored.unionByName(new)
    last = F.max(F.struct("at_us", "n", "attempts", "elapsed_s", "status"))
    return both.groupBy("path", "model", "prompt").agg(last.alias("r")).select("path", "model", "prompt", *[f"r.{c}" for c in ("status", "attempts", "elapsed_s", "at_us", "n")])


def fill_in(stored: DataFrame, late: DataFrame, key: str, keep: list[str], replace: list[str]) -> DataFrame:
    """stored with late rows merged by key: `keep` columns only fill nulls, `replace` columns take the late value."""
    a, b = stored.alias("a"), late.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    cols = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [key, *keep]] + [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in replace]
    return joined.select(*cols)


def disposition(rows: DataFrame, now_us: int, lookback_us: int, most_us: int, ahead_us: int) -> DataFrame:
    """rows with their disposition: suspect (length or clock), old, or keep."""
    bad = (F.col("dur_us") <= 0) | (F.col("dur_us") > most_us) | (F.col("start_us") > now_us + ahead_us)
    return rows.withColumn("disposition", F.when(bad, "suspect").when(F.col("start_us") < now_us - lookback_us, "old").otherwise("keep"))


def import_commits(commits: DataFrame, owner: int, cap: int) -> DataFrame:
    """An owner's commits, as author or committer, once each; the newest `cap` of a repository, and whether more are there.

    The owner filter comes before the cap.
    """
    own = commits.where((F.col("author") == owner) | (F.col("committer") == owner)).dropDuplicates(["repo", "sha"])
    w = Window.partitionBy("repo")
    rank = F.row_number().over(w.orderBy(F.desc("at_us"), F.desc("sha"))).cast("long")
    told = own.withColumns({"rank": rank, "truncated": F.count(F.lit(1)).over(w) > cap})
    return told.where(F.col("rank") <= cap).select("repo", "sha", "at_us", "rank", "truncated")


def import_file_events(files: DataFrame, bucket_us: int) -> DataFrame:
    """Work files' events, one for each path and kind in a bucket of time."""
    work = files.where(is_work_path(F.col("path"))).withColumn("bucket", F.floor(F.col("at_us") / bucket_us))
    return work.groupBy("root", "path", "kind", "bucket").agg(F.min("at_us").alias("at_us"))


def import_calendar(items: DataFrame, scope: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """Items of calendars in scope that start in a window."""
    seen = items.where((F.col("start_us") >= low_us) & (F.col("start_us") < high_us))
    return seen.join(scope, "calendar", "left_semi").select("id", "calendar", "start_us", "end_us")


def timeline(samples: DataFrame, frames: DataFrame, done: DataFrame) -> DataFrame:
    """Samples, frames that are done and frames that are not, as one stream of (device, at_us, source, id)."""
    s = samples.select("device", F.col("start_us").alias("at_us"), F.lit("sample").alias("source"), "id")
    f = frames.select("device", "at_us", "id")
    ids = done.select("id")
    ready = f.join(ids, "id", "left_semi").withColumn("source", F.lit("frame"))
    pending = f.join(ids, "id", "left_anti").withColumn("source", F.lit("pending"))
    return s.unionByName(ready).unionByName(pending)


def manifest(rows: DataFrame, source: str) -> DataFrame:
    """Rows and an order-free fingerprint of each source."""
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*rows.columns)).alias("fingerprint"))


def read_receipts(spark: SparkSession, path: str, schema: str, version: int, most_bytes: int = 4 << 20) -> DataFrame:
    """JSON receipts of one version, one a line; malformed ones and those above most_bytes are left out."""
    lines = spark.read.text(path).where(F.octet_length("value") <= most_bytes)
    told = lines.select(F.from_json("value", schema + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return told.where(F.col("_bad").isNull() & (F.col("version") == version)).drop("_bad")


def export_lines(rows: DataFrame, path: str, key: str = "device", at: str = "at_us") -> DataFrame:
    """Writes one JSON line a row, in time order within a file, a folder for each key and source; and returns the manifest
    of what is there then: rows, bytes and an order-free digest of the lines."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    told = rows.select(key, "source", line.alias("value"), F.col(at).alias("__at"))
    told.repartition(key, F.floor(F.col("__at") / DAY)).sortWithinPartitions(key, "source", "__at").select(key, "source", "value").write.partitionBy(key, "source").text(path)
    back = rows.sparkSession.read.schema(f"value string, {key} long, source string").text(path)
    piece = F.conv(F.substr(F.md5("value"), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return back.groupBy(key, "source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.sum(piece).alias("digest"))


def export_timeline(rows: DataFrame, path: str, at: str = "at_us") -> None:
    """One JSON line a row, in time order within each file, a folder for each device."""
    rows.repartition("device").sortWithinPartitions("device", at).write.mode("overwrite").partitionBy("device").json(path)


def write_changed(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rewrites only partitions whose content differs from what is stored; returns the keys written.

    The keys are a table of their own, written first, since the write changes what they were found from.
    """
    spark = rows.sparkSession
    cols = sorted(c for c in rows.columns if c not in keys)
    mark = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("h"))
    try:
        old = mark(spark.read.schema(rows.schema).parquet(path))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = mark(rows.limit(0))
    changed = written(mark(rows).join(old, [*keys, "n", "h"], "left_anti").select(*keys))
    if not changed.isEmpty():
        rows.join(changed, keys, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return changed


def append_history(rows: DataFrame, path: str, day: Column) -> None:
    """One JSON line a check, appended to its day's folder."""
    rows.withColumn("day", day).write.mode("append").partitionBy("day").json(path)
