"""Accounting checks, integrity counts and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.time import DAY, SECOND
from spanloom.operators.interval import ordered, union_us
from spanloom.sources.scratch import written


def rules_long(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))
    return df.select(*keys, F.explode(codes).alias("code"))


#: What must hold of a day's report, in microseconds: sums within 20 ms, model times within 100 ms.
ACCOUNTING = {
    "nonnegative_finite_time": "least(active_us, unattributed_us, locked_us, idle_us, observed_us, unobserved_us) >= 0",
    "known_states": "other_us = 0",
    "state_sum": "abs(active_us + unattributed_us + locked_us + idle_us + other_us - observed_us) <= 20000",
    "elapsed_reconciliation": "abs(observed_us + unobserved_us - span_us) <= 20000",
    "segment_bounds": "segments_outside = 0",
    "segment_overlap": "segments_overlapping = 0",
    "segment_sampled_time": "segments_oversampled = 0",
    "segment_sum": "abs(segment_us - observed_us) <= 20000",
    "app_time_bound": "app_us <= active_us + unattributed_us + 20000",
    "session_bounds": "sessions_outside = 0",
    "union_reconciliation": "abs(union_us - device_union_us) <= 20000",
    "session_time_bound": "device_union_us BETWEEN 0 AND span_us + 20000",
    "session_count": "sessions_declared = sessions",
    "session_app_time_bound": "longest_app_us BETWEEN 0 AND span_us + 20000",
    "frame_status_reconciliation": "status_frames = frames",
    "topic_time_reconciliation": "abs(topic_us - active_us) <= 100000",
    "suggested_time_bound": "suggested_us <= unattributed_us + 100000",
    "focus_time_reconciliation": "abs(focus_us - active_us) <= 100000",
    "context_time_reconciliation": "abs(identified_us - active_us) <= 100000",
    "context_distribution_reconciliation": "abs(distribution_us - identified_us) <= 100000",
    "context_session_count": "distribution_sessions = stretches",
    "sustained_context_bound": "sustained_us BETWEEN 0 AND identified_us + 100000",
    "longest_context_bound": "longest_us IS NULL OR longest_us BETWEEN 0 AND identified_us + 100000",
}


def accounting_report(runs: DataFrame, segments: DataFrame, parts: DataFrame, summary: DataFrame, frames: DataFrame, topics: DataFrame, suggested: DataFrame, blocks: DataFrame, stretches: DataFrame) -> DataFrame:
    """One row by device and day with all that ACCOUNTING looks at; parts of a day that are not there count as 0.

    parts are phone sessions cut by day, summary their totals by app, frames have a status each; suggested are times by
    topic, blocks and stretches have us.
    """
    keys = ["device", "day"]
    length = F.col("end_us") - F.col("start_us")
    within = (F.col("day") * DAY <= F.col("start_us")) & (F.col("start_us") < F.col("end_us")) & (F.col("end_us") <= (F.col("day") + 1) * DAY)
    spent = lambda c: F.sum(F.when(c, length).otherwise(0))
    states = ("active", "unattributed", "locked", "idle")
    front = F.col("state").isin("active", "unattributed")
    base = runs.groupBy(*keys).agg(*[spent(F.col("state") == s).alias(f"{s}_us") for s in states], spent(~F.col("state").isin(*states)).alias("other_us"), spent(front & F.col("app").isNotNull()).alias("app_us"), F.sum(length).alias("observed_us"))
    base = base.withColumns({"unobserved_us": F.greatest(F.lit(0), DAY - F.col("observed_us")), "span_us": F.lit(DAY)})
    before = F.lag("end_us").over(ordered(keys, "start_us"))
    told = segments.withColumn("before", before)
    own = told.groupBy(*keys).agg(F.count_if(~within).alias("segments_outside"), F.count_if(F.col("start_us") < F.col("before")).alias("segments_overlapping"), F.count_if((F.col("sampled_us") < 0) | (F.col("sampled_us") > length + 1000)).alias("segments_oversampled"), F.sum("sampled_us").alias("segment_us"))
    phone = parts.groupBy(*keys).agg(F.count_if(~within).alias("sessions_outside"), F.count(F.lit(1)).alias("sessions"))
    declared = summary.groupBy(*keys).agg(F.sum("sessions").alias("sessions_declared"), F.max("app_union_us").alias("longest_app_us"), F.max("device_union_us").alias("device_union_us"))
    per = frames.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("status_frames"))
    seen = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    total = lambda df, name: df.groupBy(*keys).agg(F.sum("us").cast("long").alias(name))
    behavior = stretches.groupBy(*keys).agg(F.sum("us").alias("identified_us"), F.count(F.lit(1)).alias("stretches"), F.sum(F.when(F.col("us") >= 1200 * SECOND, F.col("us")).otherwise(0)).alias("sustained_us"), F.max("us").alias("longest_us"))
    bucket = F.when(F.col("us") < 120 * SECOND, 0).when(F.col("us") < 300 * SECOND, 1).when(F.col("us") < 900 * SECOND, 2).when(F.col("us") < 1800 * SECOND, 3).otherwise(4)
    spread = stretches.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("us")).groupBy(*keys).agg(F.sum("n").alias("distribution_sessions"), F.sum("us").alias("distribution_us"))
    out = base
    for part in (own, phone, union_us(parts, keys), declared, per, seen, total(topics, "topic_us"), total(suggested, "suggested_us"), total(blocks, "focus_us"), behavior, spread):
        out = out.join(part, keys, "left")
    return out.select(*keys, *[c if c == "longest_us" else F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c not in keys])


def check_accounting(report: DataFrame) -> DataFrame:
    """(code, days): how many days break each rule of ACCOUNTING."""
    return rules_long(report, ["device", "day"], {code: F.expr(rule) for code, rule in ACCOUNTING.items()}).groupBy("code").agg(F.count(F.lit(1)).alias("days"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def wilson(df: DataFrame, k: str, n: str, z: float = 1.959963984540054) -> DataFrame:
    """df with the 95 % bounds of a share by Wilson, in parts of a million; null for n = 0."""
    p = F.try_divide(F.col(k).cast("double"), F.col(n).cast("double"))
    m = F.col(n).cast("double")
    mid = p + z * z / (2 * m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    ok = lambda x: F.when(F.col(n) > 0, F.floor(x / (1 + z * z / m) * 1e6 + 0.5).cast("long"))
    return df.withColumns({"low_ppm": ok(mid - half), "high_ppm": ok(mid + half)})


def cluster_bootstrap(pairs: DataFrame, cluster: str, a: str, b: str, draws: int = 2000, seed: int = 17) -> DataFrame:
    """Mean difference a - b of paired rows, its 95 % percentile interval from resampling whole clusters, wins and losses.

    Each draw picks as many clusters as there are, with replacement: pick j of draw i is the cluster whose number, in order
    of the clusters, is a hash of (i, j, seed) modulo their count. Only cluster sums are picked, never rows, and a draw's
    picks meet in one sum. The interval is the sorted draws at 2.5 % and 97.5 %; null for fewer than two clusters.
    """
    sums = pairs.groupBy(cluster).agg(F.sum(F.col(a) - F.col(b)).alias("d"), F.count(F.lit(1)).alias("n"))
    told = written(numbered_clusters(sums, cluster))
    count = told.count()
    piece = F.conv(F.substr(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("place").cast("string"), F.lit(str(seed)))), F.lit(1), F.lit(8)), 16, 10).cast("long")
    picks = told.select("place", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("draw", (piece % max(1, count)).alias("place"))
    taken = picks.groupBy("place", "draw").agg(F.count(F.lit(1)).alias("w")).join(told.select("place", "d", "n"), "place")
    per = taken.groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    ranked = per.withColumn("r", F.row_number().over(Window.orderBy("m", "draw")) - 1)  # as many rows as draws
    at = lambda q: F.max(F.when(F.col("r") == min(draws - 1, int(draws * q)), F.col("m")))
    ends = ranked.agg(at(0.025).alias("low"), at(0.975).alias("high"))
    d = F.col(a) - F.col(b)
    whole = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(d).alias("difference"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    ok = lambda c: F.when(F.lit(count >= 2), F.col(c)).alias(c)
    return whole.join(F.broadcast(ends)).select("pairs", F.lit(count).cast("long").alias("clusters"), "difference", ok("low"), ok("high"), "wins", "losses", "ties")  # one row each


def numbered_clusters(sums: DataFrame, cluster: str) -> DataFrame:
    """sums with `place`, the number from 0 of each cluster in order: counted by ranges first, then within each."""
    ranged = written(sums.repartitionByRange(F.col(cluster)).withColumn("__p", F.spark_partition_id()))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(cluster)) - 1
    return ranged.withColumn("__own", own).join(base, "__p").withColumn("place", F.col("__base") + F.col("__own")).drop("__p", "__own", "__base")


def variant_metrics(rows: DataFrame, variant: str, truth: str, guess: str) -> DataFrame:
    """By variant: rows, answers, right ones, abstentions; a null guess abstains and stays in the denominator."""
    return rows.groupBy(variant).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(guess).alias("answered"),
        F.count_if(F.col(guess) == F.col(truth)).alias("right"),
        F.count_if(F.col(guess).isNull()).alias("abstained"),
    )


def no_regression(base: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Whether every paired row is at least as good, how many are worse, and how many pairs there are."""
    met = base.select(key, F.col(value).alias("x")).join(new.select(key, F.col(value).alias("y")), key)
    return met.agg(F.bool_and(F.col("y") >= F.col("x")).alias("holds"), F.count_if(F.col("y") < F.col("x")).alias("worse"), F.count(F.lit(1)).alias("pairs"))


def select_best(candidates: DataFrame, gate: Column, order: list[str], key: str) -> DataFrame:
    """The best candidate that passes, by columns in turn, the smaller key on a tie."""
    return candidates.where(gate).orderBy(*[F.desc(c) for c in order], key).limit(1)


def blind(rows: DataFrame, id_col: str, variant: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """An anonymous review table in a reproducible order, and the key table that names what each row was."""
    key = F.substr(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(variant).cast("string")), 256), F.lit(1), F.lit(16))
    told = rows.withColumn("review_id", key)
    return told.drop(id_col, variant), told.select("review_id", id_col, variant)
