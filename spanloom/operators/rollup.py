"""Facts by day, month and year, and the dense views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import is_work_path
from spanloom.functions.time import DAY, HOUR, SECOND
from spanloom.operators.interval import by_day, union_us

KEYS = ["device", "day"]


def work_artifacts(commits: DataFrame, files: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Commits of the k busiest repositories; and by root, events and distinct paths of work files."""
    per = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"))
    top = per.orderBy(F.desc("commits"), "repo").limit(k)
    work = files.withColumn("work", is_work_path(F.col("path")))
    by_root = work.groupBy("root").agg(F.count(F.lit(1)).alias("events"), F.count_if("work").alias("work_events"), F.count_distinct(F.when(F.col("work"), F.col("path"))).alias("work_files"))
    return top, by_root


def calendar_summary(items: DataFrame, zone: Column | str | None = None) -> DataFrame:
    """Timed events below 24 hours by day: union and count; all-day items don't count."""
    timed = items.where(~F.col("all_day") & (F.col("end_us") > F.col("start_us")) & (F.col("end_us") - F.col("start_us") < 24 * HOUR))
    parts = by_day(timed, zone)
    return union_us(parts, ["day"]).join(parts.groupBy("day").agg(F.count_distinct("id").alias("events")), "day")


def day_facts(states: DataFrame, apps: DataFrame, sessions: DataFrame, behavior: DataFrame, *more: DataFrame) -> DataFrame:
    """One wide row by device and day; parts that are missing stay null, and a ladder tells the coverage.

    `more` are further parts (frames, suggestions, calendar, artifacts), of one row by day or by device and day.
    """
    app = apps.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("apps"), F.sum("us").alias("foreground_us"))
    own = sessions.groupBy(*KEYS).agg(F.first("device_union_us").alias("session_union_us"))
    wide = states.join(app, KEYS, "left").join(own, KEYS, "left").join(behavior.select(*KEYS, F.col("sessions").alias("stretches"), "switches", "longest_us"), KEYS, "left")
    status = F.when(F.col("observed_us") >= 12 * HOUR, "full").when(F.col("observed_us") >= 4 * HOUR, "partial").otherwise("sparse")
    for part in more:
        wide = wide.join(part, [k for k in KEYS if k in part.columns], "left")
    return wide.withColumn("coverage", status)


def period_totals(totals: DataFrame, label: str, value: str) -> DataFrame:
    """Totals by device and day of a label, merged into months and years (month null): a sum by each, not an average."""
    date = F.date_add(F.to_date(F.lit("1970-01-01")), F.col("day").cast("int"))
    told = totals.withColumns({"year": F.year(date).cast("long"), "month": F.month(date).cast("long")})
    grouped = told.groupingSets([["device", "year", "month", label], ["device", "year", label]], "device", "year", "month", label)
    return grouped.agg(F.sum(value).alias(value), F.count_distinct("day").alias("days"))


def day_sketches(rows: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """By keys (with day): a sketch of the distinct items and one of the values' distribution, some kilobytes a day, which
    period_sketches() merges, so that a period's distinct count and quantiles need no rows of its days."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(item).alias("items"), F.expr(f"kll_sketch_agg_bigint({value})").alias("amounts"))


def period_sketches(days: DataFrame, keys: list[str]) -> DataFrame:
    """Merged day_sketches() by keys: estimated distinct items, and the median and ninth decile of the values."""
    merged = days.groupBy(*keys).agg(F.hll_union_agg("items").alias("items"), F.expr("kll_merge_agg_bigint(amounts)").alias("amounts"))
    quantile = lambda q: F.expr(f"kll_sketch_get_quantile_bigint(amounts, {q}D)")
    return merged.select(*keys, F.hll_sketch_estimate("items").alias("distinct_items"), quantile(0.5).alias("median"), quantile(0.9).alias("p90"))


def period_rollup(facts: DataFrame) -> DataFrame:
    """Month and year in one pass: sums, and days by coverage."""
    date = F.date_add(F.to_date(F.lit("1970-01-01")), F.col("day").cast("int"))
    told = facts.withColumns({"year": F.year(date).cast("long"), "month": F.month(date).cast("long")})
    grouped = told.groupingSets([["device", "year", "month"], ["device", "year"]], "device", "year", "month")
    return grouped.agg(F.count(F.lit(1)).alias("days"), F.sum("observed_us").alias("observed_us"), F.sum("active_us").alias("active_us"), F.count_if(F.col("coverage") == "full").alias("full_days"), F.max("longest_us").alias("longest_us"))


def densify(facts: DataFrame, keys: list[str], day: str, low: Column, high: Column) -> DataFrame:
    """A row for each day from low to high (bounded columns of the keys' own rows); absent ones say missing."""
    spine = facts.groupBy(*keys).agg(low.alias("__l"), high.alias("__h")).select(*keys, F.explode(F.sequence("__l", "__h")).alias(day))
    return spine.join(facts.withColumn("__seen", F.lit(True)), [*keys, day], "left").withColumn("missing", F.col("__seen").isNull()).drop("__seen")


def densify_week(facts: DataFrame) -> DataFrame:
    """The seven days that end with a device's last."""
    return densify(facts, ["device"], "day", F.max("day") - 6, F.max("day"))


def evolution(totals: DataFrame, k: int = 5) -> DataFrame:
    """Time by day of a device's top k labels, the other titled ones, and unknown."""
    per = totals.where("label IS NOT NULL").groupBy("device", "label").agg(F.sum("us").alias("all_us"))
    rank = F.row_number().over(Window.partitionBy("device").orderBy(F.desc("all_us"), "label"))
    top = per.withColumn("r", rank).where(F.col("r") <= k).select("device", "label", F.lit(True).alias("top"))
    named = totals.join(top, ["device", "label"], "left").withColumn("shown", F.when(F.col("label").isNull(), "Unknown").when(F.col("top"), F.col("label")).otherwise("Other"))
    return named.groupBy("device", "day", F.col("shown").alias("label")).agg(F.sum("us").alias("us"))


def history_overlay(recent: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """All days once: a recent detailed day replaces the stored compact one."""
    both = recent.withColumn("p", F.lit(0)).unionByName(stored.withColumn("p", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("p"))).where("r = 1").drop("r", "p")


def day_alerts(facts: DataFrame) -> DataFrame:
    """Codes by device and day, in order: quality_failed (column failed), unknown_high (over 300 s and 15 % of observed),
    phone_stale (phone_age_us of 6 hours or more, or unknown), coverage_low, no_foreground."""
    rules = {
        "quality_failed": F.col("failed"),
        "unknown_high": F.col("unattributed_us") > F.greatest(F.lit(300 * SECOND), F.expr("observed_us * 15 div 100")),
        "phone_stale": F.coalesce(F.col("phone_age_us") >= 6 * HOUR, F.lit(True)),
        "coverage_low": F.col("observed_us") < 4 * HOUR,
        "no_foreground": F.col("active_us") + F.col("unattributed_us") == 0,
    }
    return facts.select(*KEYS, F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()])), ",").alias("codes"))


def review_document() -> Column:
    """A day's facts as a JSON document for a reader."""
    return F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"), "device", "day", "coverage",
            F.struct(F.col("active_us").alias("identified_us"), F.col("unattributed_us").alias("window_unknown_us"), "unobserved_us").alias("computer"),
            F.struct(F.col("session_union_us").alias("union_us")).alias("phone"),
            F.struct(F.col("stretches").alias("sessions"), "switches", "longest_us").alias("behavior"),
        ),
        {"ignoreNullFields": "false"},
    )


def touched_days(rows: DataFrame, stored: DataFrame, recent_days: int = 8) -> DataFrame:
    """Days to recompute: their fingerprint differs from the stored one, they are new, or among the last ones.

    A fingerprint is the count and the xor of row hashes: independent of order, and made with a map-side combine.
    """
    now = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[c for c in rows.columns])).alias("h"))
    last = rows.agg(F.max("day").alias("last"))
    # The last join is of one row, the last day.
    met = now.join(stored.select(*KEYS, F.col("n").alias("n0"), F.col("h").alias("h0")), KEYS, "left").join(F.broadcast(last))
    stale = ~(F.col("n").eqNullSafe(F.col("n0")) & F.col("h").eqNullSafe(F.col("h0"))) | (F.col("day") > F.col("last") - recent_days)
    return met.where(stale).select(*KEYS, "n", "h")


def week_heatmap(hours: DataFrame) -> DataFrame:
    """Active seconds by device, day and hour, and their level; hours without data are missing, not zero."""
    from spanloom.functions.text import heat_level

    s = hours.where("state = 'active'").select("device", "day", "hour", (F.col("us") / SECOND).alias("s"))
    spine = hours.select("device", "day").distinct().select("device", "day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    return spine.join(s, ["device", "day", "hour"], "left").select("device", "day", "hour", heat_level(F.col("s")).alias("level"), F.col("s").isNull().alias("missing"))


__all__ = ["DAY", "calendar_summary", "day_alerts", "day_facts", "day_sketches", "densify", "densify_week", "evolution", "history_overlay", "period_rollup", "period_sketches", "period_totals", "review_document", "touched_days", "week_heatmap", "work_artifacts"]
