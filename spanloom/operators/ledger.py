"""Rules of a ledger of observations: runs that add up, items in scope, tab events, stores, receipts and their age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.time import DAY, MINUTE, SECOND
from spanloom.operators.evidence import first_reason
from spanloom.operators.interval import by_day

STATES = ("active", "unattributed", "idle", "locked")
TAB_EVENTS = ("tab_active", "tab_updated", "window_focused", "browser_blur")


def validate_runs(samples: DataFrame, support: DataFrame) -> DataFrame:
    """(id, code) for each rule that a sample breaks; a ledger without rows here may be accounted.

    samples: id, device, start_us, end_us, state, sampled_us. support: id, start_us, end_us. Codes: unknown_state,
    not_positive, no_support, support_outside, support_sum (support doesn't add up to sampled_us, to the microsecond), and
    overlap (it begins before an earlier sample of its device ends).
    """
    own = support.select(F.col("id").alias("__id"), F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    met = samples.select("id", "start_us", "end_us", "sampled_us", "state").join(own, F.col("id") == F.col("__id"), "left")
    inside = (F.col("start_us") <= F.col("s")) & (F.col("s") < F.col("e")) & (F.col("e") <= F.col("end_us"))
    told = met.groupBy("id", "start_us", "end_us", "sampled_us", "state").agg(F.count("s").alias("parts"), F.count_if(~inside).alias("outside"), F.sum(F.col("e") - F.col("s")).alias("us"))
    rules = {
        "unknown_state": F.coalesce(F.col("state").isin(*STATES), F.lit(False)),
        "not_positive": F.col("start_us") < F.col("end_us"),
        "no_support": F.col("parts") > 0,
        "support_outside": F.col("outside") == 0,
        "support_sum": F.coalesce(F.col("us") == F.col("sampled_us"), F.col("parts") == 0),
    }
    codes = F.array_compact(F.array(*[F.when(~ok, F.lit(code)) for code, ok in rules.items()]))
    # Two samples that overlap share a day in which the later one begins, so days can be looked at one by one.
    parts = by_day(samples.where("end_us > start_us").withColumn("until_us", F.col("end_us")))
    w = Window.partitionBy("device", "day").orderBy("from_us", "until_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    late = parts.withColumn("reach", F.max("end_us").over(w)).where("start_us < reach").select("id", F.lit("overlap").alias("code")).distinct()
    return told.select("id", F.explode(codes).alias("code")).unionByName(late)


def calendar_items(items: DataFrame, scope: DataFrame, now_us: int) -> DataFrame:
    """items with a disposition, a stable row_id and the title that may be shown.

    items: id, kind (event or reminder), calendar, title, start_us, end_us. scope: kind, calendar, with_title. By rank:
    unscoped, no_id, health (the title tells of health), outside (of 366 days back to 31 ahead), keep.
    """
    met = items.join(scope.withColumn("__in", F.lit(True)), ["kind", "calendar"], "left")
    title = T.cut_text(F.col("title"))
    rules = [
        ("unscoped", F.col("__in").isNull()),
        ("no_id", F.col("id").isNull()),
        ("health", F.col("title").rlike(T.HEALTH)),
        ("outside", ~F.col("start_us").between(now_us - 366 * DAY, now_us + 31 * DAY)),
    ]
    row_id = F.sha2(F.concat_ws(":", "kind", F.col("calendar").cast("string"), F.col("id").cast("string")), 256)
    shown = F.when(F.col("with_title") & (title != ""), title)
    return met.withColumns({"disposition": first_reason(rules, "keep"), "row_id": row_id, "shown": shown}).drop("__in", "with_title", "title").withColumnRenamed("shown", "title")


def tab_events(messages: DataFrame) -> DataFrame:
    """messages (kind, at_us, received_us, domain, incognito, tab_id, window_id) with verdict and site_host.

    By rank: incognito, bad_type, bad_clock (over 300 s from when it came), bad_domain, no_domain, bad_id, accepted.
    """
    host = F.lower("domain")
    fits = lambda c: F.coalesce(F.col(c), F.lit(0)).between(0, 2**31 - 1)
    rules = [
        ("incognito", F.col("incognito")),
        ("bad_type", F.coalesce(~F.col("kind").isin(*TAB_EVENTS), F.lit(True))),
        ("bad_clock", F.coalesce(F.abs(F.col("received_us") - F.col("at_us")) > 300 * SECOND, F.lit(True))),
        ("bad_domain", ~host.rlike(r"^[a-z0-9.-]{1,253}$") & (host != "")),
        ("no_domain", (F.col("kind") != "browser_blur") & (F.coalesce(host, F.lit("")) == "")),
        ("bad_id", ~fits("tab_id") | ~fits("window_id")),
    ]
    verdict = first_reason(rules, "accepted")
    return messages.withColumn("verdict", verdict).withColumn("site_host", F.when((F.col("verdict") == "accepted") & (host != ""), host))


def discover_stores(candidates: DataFrame) -> DataFrame:
    """One store for each common directory (path, common_dir): the first path, and how many candidates share it."""
    key = F.substr(F.sha2("common_dir", 256), F.lit(1), F.lit(20))
    return candidates.groupBy(key.alias("common_key")).agg(F.min("path").alias("store"), F.count(F.lit(1)).alias("candidates"))


def freshness(receipts: DataFrame, limits: DataFrame, now_us: Column | int, keys: list[str]) -> DataFrame:
    """Each kind of limits for each of keys: whether there is a receipt, its age, and whether that is within the kind's.

    receipts: keys, kind, at_us. limits: kind, limit_us, a fixed table of few kinds. A receipt up to 30 s ahead of the clock is fresh too; a kind
    without any is not, and has no age.
    """
    last = receipts.groupBy(*keys, "kind").agg(F.max("at_us").alias("at_us"))
    asked = receipts.select(*keys).distinct().join(F.broadcast(limits))  # as many rows for a key as there are kinds
    age = (F.lit(now_us) if isinstance(now_us, int) else now_us) - F.col("at_us")
    met = asked.join(last, [*keys, "kind"], "left").withColumn("age_us", age)
    return met.select(*keys, "kind", F.col("at_us").isNotNull().alias("exists"), "age_us", F.coalesce(F.col("age_us").between(-30 * SECOND, F.col("limit_us")), F.lit(False)).alias("fresh"))


def source_quality(readers: DataFrame) -> DataFrame:
    """readers (reader_exit, checked_us, age_min, ledger_us, now_us) with source and lag ages in minutes, and status.

    A receipt tells when it was made and how old the source's latest start was. By rank: reader_failed,
    source_timestamp_unavailable, source_stale (36 hours), source_behind_retained_ledger (5 minutes),
    no_retained_events, source_current_relative_to_ledger.
    """
    start = F.col("checked_us") - F.col("age_min") * MINUTE
    told = readers.withColumns({"source_age_min": (F.col("now_us") - start) / MINUTE, "behind_min": (F.col("ledger_us") - start) / MINUTE})
    rules = [
        ("reader_failed", F.col("reader_exit") != 0),
        ("source_timestamp_unavailable", F.col("source_age_min").isNull()),
        ("source_stale", F.col("source_age_min") > 36 * 60),
        ("source_behind_retained_ledger", F.col("behind_min") > 5),
        ("no_retained_events", F.col("ledger_us").isNull()),
    ]
    return told.withColumn("status", first_reason(rules, "source_current_relative_to_ledger"))


def title_suspects(frames: DataFrame) -> Column:
    """Whether a frame (app, win, at_us) has the title of the sample before it (match_us, s_app, s_win), no more than 15 s
    old, under another app: the title may have been filled in later."""
    near = (F.col("at_us") - F.col("match_us")).between(0, 15 * SECOND)
    return F.coalesce(near & (F.col("s_app") != F.col("app")) & (F.col("s_win") == F.col("win")), F.lit(False))


def integrity(samples: DataFrame, children: dict[str, tuple[DataFrame, DataFrame]], now_us: int, most_us: int) -> DataFrame:
    """(device, check, rows): future starts (over 5 minutes ahead), invalid durations, and child rows without a parent.

    samples: device, start_us, dur_us. children: for each check (rows with device and id, parents with id).
    """
    bad = F.col("dur_us").isNull() | (F.col("dur_us") <= 0) | (F.col("dur_us") > most_us)
    per = samples.groupBy("device").agg(F.count_if(F.col("start_us") > now_us + 5 * MINUTE).alias("future"), F.count_if(bad).alias("invalid"))
    out = per.unpivot(["device"], ["future", "invalid"], "check", "rows")
    for name, (rows, parents) in children.items():
        lost = rows.join(parents.select("id").distinct(), "id", "left_anti")
        out = out.unionByName(lost.groupBy("device").agg(F.count(F.lit(1)).alias("rows")).withColumn("check", F.lit(name)))
    return out
