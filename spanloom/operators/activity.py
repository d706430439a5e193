"""Observed activity: runs, segments, sessions, blocks and totals by device and day.

A second counts once within a device; devices are never added up; a gap is unknown, not idle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import is_sensitive
from spanloom.functions.time import DAY, HOUR, MINUTE, SECOND, day_start, local_us
from spanloom.operators.asof import asof
from spanloom.operators.interval import by_day, cut, day_spans, islands, merge, ordered, overlap_join, point_join, trim, union_us

MERGE_GAP, SESSION_GAP, STRETCH_GAP = 2 * SECOND, 1 * SECOND, 20 * SECOND
BLOCK = 900 * SECOND
KEYS = ["device", "day"]
BUCKETS = ((0, 120), (120, 300), (300, 900), (900, 1800), (1800, None))
PRECEDENCE = ("active", "unattributed", "locked", "idle")


def valid(samples: DataFrame, most_us: int) -> DataFrame:
    """Samples with 0 < duration <= most_us."""
    return samples.where((F.col("dur_us") > 0) & (F.col("dur_us") <= most_us))


# The sources that tell where the user is.
KNOWN_SOURCES = ("mac_window_sample", "mac_idle", "mac_locked", "mac_window_legacy", "mac_idle_legacy")


def valid_sources(samples: DataFrame, most_us: int = 30 * SECOND, legacy_us: int = 6 * HOUR) -> DataFrame:
    """Samples of known sources with 0 < duration, of most_us at most, or legacy_us from a source that ends in _legacy."""
    most = F.when(F.endswith("source", F.lit("_legacy")), legacy_us).otherwise(most_us)
    return samples.where(F.col("source").isin(*KNOWN_SOURCES) & (F.col("dur_us") > 0) & (F.col("dur_us") <= most))


def observed_runs(samples: DataFrame, most_us: int = 6 * HOUR, zone: Column | str | None = None) -> DataFrame:
    """Disjoint observed runs by device and day: valid samples, cut at midnight and at the next sample's start.

    Days are UTC ones, or those of `zone`, a zone's name or a column with one for each device.
    """
    known = valid(samples, most_us).withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    return trim(by_day(known, zone), KEYS, "start_us", "from_us", "id").drop("dur_us")


def _changes(cols: list[str], gap_us: int, w) -> Column:
    same = [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in cols]
    gap = F.col("start_us") - F.lag("end_us").over(w)
    ok = gap.between(0, gap_us)
    for s in same:
        ok = ok & s
    return ~F.coalesce(ok, F.lit(False))


def segments(runs: DataFrame, gap_us: int = MERGE_GAP, same: tuple[str, ...] = ("state", "app", "win")) -> DataFrame:
    """Neighbouring runs that agree in all columns of `same`, at most gap_us apart, with sample count, sampled time and
    support. With a site's host or the evidence among these, a change of either is a segment of its own."""
    w = ordered(KEYS, "start_us")
    told = islands(runs.withColumn("new", _changes(list(same), gap_us, w)), KEYS, F.col("new"), "start_us")
    return told.groupBy(*KEYS, "island").agg(
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        *[F.first(c).alias(c) for c in same],
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("sampled_us"),
    )


def support(runs: DataFrame, gap_us: int = MERGE_GAP) -> DataFrame:
    """Exact support of each segment: its runs, those that touch joined."""
    w = ordered(KEYS, "start_us")
    told = islands(runs.withColumn("new", _changes(["state", "app", "win"], gap_us, w)), KEYS, F.col("new"), "start_us")
    return merge(told, [*KEYS, "island"])


def state_totals(runs: DataFrame, zone: Column | str | None = None) -> DataFrame:
    """Time in each state by device and day, their sum, and the rest of the day, of 24 hours or as long as it is in `zone`,
    as unobserved."""
    length = F.col("end_us") - F.col("start_us")
    sums = {f"{s}_us": F.sum(F.when(F.col("state") == s, length).otherwise(0)) for s in PRECEDENCE}
    whole = F.lit(DAY) if zone is None else F.max(day_start(F.col("day") + 1, zone) - day_start(F.col("day"), zone))
    total = runs.groupBy(*KEYS).agg(*[v.alias(k) for k, v in sums.items()], F.sum(length).alias("observed_us"), whole.alias("day_us"))
    return total.withColumn("unobserved_us", F.greatest(F.lit(0), F.col("day_us") - F.col("observed_us"))).drop("day_us")


def app_totals(runs: DataFrame) -> DataFrame:
    """Foreground time by app, and the part of it without a title."""
    length = F.col("end_us") - F.col("start_us")
    front = runs.where(F.col("state").isin("active", "unattributed") & F.col("app").isNotNull())
    return front.groupBy(*KEYS, "app").agg(F.sum(length).alias("us"), F.sum(F.when(F.col("state") == "unattributed", length).otherwise(0)).alias("app_only_us"))


def session_summary(sessions: DataFrame, zone: Column | str | None = None) -> DataFrame:
    """Overlapping sessions by device and day: sum, union and overlap; and by app, whose rows have all of these."""
    parts = by_day(sessions, zone)
    raw = parts.groupBy(*KEYS, "app").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.col("end_us") - F.col("start_us")).alias("raw_us"))
    own = union_us(parts, [*KEYS, "app"], "app_union_us")
    whole = union_us(parts, KEYS, "device_union_us")
    return raw.join(own, [*KEYS, "app"]).join(whole, KEYS).withColumn("overlap_us", F.col("raw_us") - F.col("app_union_us"))


def local_hours(df: DataFrame, zone: Column | str = "UTC") -> DataFrame:
    """Intervals cut at local hours, with `hour` from 0 to 23; an hour that repeats gives pieces of one number."""
    slots = cut(df, HOUR // 4)  # zones are quarters of an hour apart
    return slots.withColumn("hour", F.pmod(F.floor(local_us(F.col("start_us"), zone) / HOUR), F.lit(24))).drop("slot")


def hour_profile(runs: DataFrame, zone: Column | str = "UTC") -> DataFrame:
    """Time by device, local hour of the day and state. A repeated hour adds up."""
    return local_hours(runs, zone).groupBy("device", "hour", "state").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))


def hours_of_day(runs: DataFrame, sessions: DataFrame, zone: Column | str = "UTC") -> DataFrame:
    """All 24 local hours of each device: computer time by state, and the union of phone sessions; 0 where there is none.

    A phone's sessions are merged by device and UTC day first, so that overlapping ones count once.
    """
    length = F.col("end_us") - F.col("start_us")
    computer = local_hours(runs, zone).groupBy("device", "hour").agg(*[F.sum(F.when(F.col("state") == s, length).otherwise(0)).alias(f"{s}_us") for s in PRECEDENCE])
    one = sessions.select("device", "start_us", "end_us", (zone if isinstance(zone, Column) else F.lit(zone)).alias("zone"))
    phone = local_hours(merge(by_day(one), ["device", "day", "zone"]), F.col("zone")).groupBy("device", "hour").agg(F.sum(length).alias("phone_us"))
    devices = runs.select("device").unionByName(sessions.select("device")).distinct()
    spine = devices.select("device", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    wide = spine.join(computer, ["device", "hour"], "left").join(phone, ["device", "hour"], "left")
    return wide.select("device", "hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*[f"{s}_us" for s in PRECEDENCE], "phone_us")])


def activity_bins(runs: DataFrame, step_us: int = 5 * MINUTE) -> DataFrame:
    """Bins of step_us: time by state, the state of highest precedence there, and the app with most time, first seen on a tie."""
    parts = cut(runs, step_us)
    length = F.col("end_us") - F.col("start_us")
    apps = parts.where("app IS NOT NULL").groupBy("device", "slot", "app").agg(F.sum(length).alias("us"), F.min("start_us").alias("seen"))
    top = apps.groupBy("device", "slot").agg(F.max_by("app", F.struct("us", -F.col("seen"))).alias("top_app"))
    sums = parts.groupBy("device", "slot").agg(*[F.sum(F.when(F.col("state") == s, length).otherwise(0)).alias(f"{s}_us") for s in PRECEDENCE])
    state = F.lit("unknown")
    for s in reversed(PRECEDENCE):
        state = F.when(F.col(f"{s}_us") > 0, s).otherwise(state)
    return sums.withColumn("state", state).join(top, ["device", "slot"], "left")


def dense_bins(bins: DataFrame, step_us: int, keys: list[str] = ["device"]) -> DataFrame:  # noqa: B006
    """bins with a row for each slot of each day that has any; slots without data say so: observed is false, times null."""
    per_day = DAY // step_us
    days = bins.select(*keys, F.floor(F.col("slot") / per_day).alias("day")).distinct()
    spine = days.select(*keys, F.explode(F.sequence(F.col("day") * per_day, (F.col("day") + 1) * per_day - 1)).alias("slot"))
    return spine.join(bins.withColumn("observed", F.lit(True)), [*keys, "slot"], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def behavior_sessions(segs: DataFrame, gap_us: int = SESSION_GAP) -> DataFrame:
    """Stretches of one context (here one app and window): anything else between, or a longer gap, ends a stretch."""
    w = ordered(KEYS, "start_us")
    context = F.when((F.col("state") == "active") & (F.col("sampled_us") > 0), F.concat_ws("/", "app", "win"))
    told = segs.withColumn("context", context).withColumn("gap", F.col("start_us") - F.lag("end_us").over(w))
    same = F.col("context").isNotNull() & F.coalesce(F.lag("context").over(w) == F.col("context"), F.lit(False)) & F.coalesce(F.col("gap").between(0, gap_us), F.lit(False))
    told = told.withColumn("same", same)
    grouped = islands(told, KEYS, ~F.col("same"), "start_us", into="stretch").where("context IS NOT NULL")
    return grouped.groupBy(*KEYS, "stretch").agg(F.first("context").alias("context"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("sampled_us").alias("us"), F.count(F.lit(1)).alias("parts")).drop("stretch")


def behavior_measures(sessions: DataFrame) -> DataFrame:
    """Counts, switches, longest, sustained (20 minutes or more) and brief (below 2 minutes) stretches by device and day.

    A switch is a change of context from one stretch to the next; the median is of stretch times.
    """
    w = ordered(KEYS, "start_us")
    told = sessions.withColumn("switch", F.coalesce((F.lag("context").over(w) != F.col("context")).cast("long"), F.lit(0)))
    return told.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("switch").alias("switches"),
        F.sum("us").alias("us"),
        F.max("us").alias("longest_us"),
        F.median("us").alias("median_us"),
        F.count_if(F.col("us") >= 1200 * SECOND).alias("sustained"),
        F.count_if(F.col("us") < 120 * SECOND).alias("brief"),
    )


def duration_histogram(sessions: DataFrame) -> DataFrame:
    """Stretches and their time in five buckets of seconds, upper bounds exclusive; empty buckets are there."""
    spark = sessions.sparkSession
    bucket = F.lit(len(BUCKETS) - 1)
    for i in range(len(BUCKETS) - 2, -1, -1):
        bucket = F.when(F.col("us") < BUCKETS[i][1] * SECOND, i).otherwise(bucket)
    counted = sessions.groupBy("device", bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("us").alias("us"))
    # Five rows for each device.
    spine = sessions.select("device").distinct().join(F.broadcast(spark.range(len(BUCKETS)).withColumnRenamed("id", "bucket")))
    return spine.join(counted, ["device", "bucket"], "left").select("device", "bucket", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("us", F.lit(0)).alias("us"))


def behavior_period(sessions: DataFrame) -> DataFrame:
    """Measures over all days of a device; the rate is recomputed from sums, never averaged."""
    m = behavior_measures(sessions)
    p = m.groupBy("device").agg(F.count(F.lit(1)).alias("days"), F.sum("sessions").alias("sessions"), F.sum("switches").alias("switches"), F.sum("us").alias("us"), F.max("longest_us").alias("longest_us"))
    return p.withColumn("switches_per_day_x1000", F.expr("switches * 1000 div days"))


def app_stretches(segs: DataFrame, gap_us: int = STRETCH_GAP) -> DataFrame:
    """Wall time of stretches of one app with gaps of gap_us at most, and the window changes inside."""
    front = segs.where("state = 'active'")
    w = ordered(KEYS, "start_us")
    told = front.withColumns({"new": _changes(["app"], gap_us, w), "moved": (~F.lag("win").over(w).eqNullSafe(F.col("win"))).cast("long")})
    told = islands(told, KEYS, F.col("new"), "start_us", into="stretch").withColumn("moved", F.when(F.col("new"), 0).otherwise(F.col("moved")))
    return told.groupBy(*KEYS, "stretch").agg(F.first("app").alias("app"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("moved").alias("window_changes")).drop("stretch")


def longest_app_stretch(segs: DataFrame) -> DataFrame:
    """The longest wall stretch of one app by device and day; the earliest of equal ones."""
    found = app_stretches(segs).withColumn("wall_us", F.col("end_us") - F.col("start_us"))
    best = F.max_by(F.struct("app", "wall_us", "window_changes", "start_us"), F.struct("wall_us", -F.col("start_us")))
    return found.groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, "b.*")


def _block_starts(df: DataFrame, most_us: int) -> DataFrame:
    """df (KEYS, part, start_us, end_us, ...) with `begin`: the start of the block that holds the row's start.

    A block ends most_us after its start if a row covers that moment, else with the last row that starts before it. So a
    row's block depends on the block before: one pass over rows in order, with one number carried along.
    """
    cols = df.columns

    def run(batches):
        last, begin = None, 0
        for pdf in batches:
            out = []
            for key, s, e in zip(zip(pdf.device, pdf.day, pdf.part, strict=True), pdf.start_us.tolist(), pdf.end_us.tolist(), strict=True):
                if key != last or s - begin >= most_us:
                    last, begin = key, s
                out.append(begin)
                begin += max(0, (e - begin - 1) // most_us) * most_us
            yield pdf.assign(begin=out)[[*cols, "begin"]]

    return df.repartition(*KEYS).sortWithinPartitions(*KEYS, "part", "start_us").mapInPandas(run, df.schema.add("begin", "long"))


def _pieces(df: DataFrame, most_us: int) -> DataFrame:
    """df's rows once for each block that they meet, `block` being where that begins."""
    return _block_starts(df, most_us).withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end_us") - F.col("begin") - 1) / most_us)), lambda j: F.col("begin") + j * most_us)))


def _blocks(df: DataFrame, most_us: int, first: list[str], sampled: str | None = None) -> DataFrame:
    """The blocks of df's parts; rows that cross a block's end count in both, their time pro rata."""
    cut = _pieces(df, most_us)
    low, high = F.greatest("start_us", "block"), F.least(F.col("end_us"), F.col("block") + most_us)
    us = (high - low) if sampled is None else F.col(sampled).cast("double") * (high - low) / (F.col("end_us") - F.col("start_us"))
    # A block may begin before the row it was found in, never after.
    return cut.groupBy(*KEYS, "part", "block").agg(F.min(low).alias("start_us"), F.max(high).alias("end_us"), F.sum(us).alias("us"), *[F.first(c).alias(c) for c in first]).drop("part", "block")


def _focus_parts(segs: DataFrame, gap_us: int) -> DataFrame:
    """Foreground segments with `part`: runs of one app, a barrier or a longer gap between."""
    w = ordered(KEYS, "start_us")
    told = segs.withColumn("ok", (F.col("state") == "active") & (F.col("sampled_us") > 0))
    told = told.withColumn("new", F.coalesce(~F.lag("ok").over(w), F.lit(True)) | _changes(["app"], gap_us, w))
    return islands(told, KEYS, F.col("new"), "start_us", into="part").where("ok")


def focus_blocks(segs: DataFrame, most_us: int = BLOCK, gap_us: int = STRETCH_GAP) -> DataFrame:
    """Blocks of one app of most_us at most from their start; segments that pass it are cut, with their time pro rata.

    Parts by app, gap and barrier come first; the greedy cut happens inside them.
    """
    told = _focus_parts(segs, gap_us)
    found = _blocks(told.select(*KEYS, "part", "start_us", "end_us", "app", "sampled_us"), most_us, ["app"], "sampled_us")
    return found.withColumn("block", F.row_number().over(ordered(KEYS, "start_us")).cast("long"))


def block_windows(segs: DataFrame, k: int = 5, most_us: int = BLOCK, gap_us: int = STRETCH_GAP) -> DataFrame:
    """What each focus block holds: its k titles with most time (of equal ones the first seen), and how many there are.

    Gives KEYS, start_us (where the block's first title is seen), title, us, rank, windows. Sensitive titles are one.
    """
    title = F.when(is_sensitive(F.col("win")), "[sensitive window]").otherwise(F.col("win"))
    cut = _pieces(_focus_parts(segs, gap_us).select(*KEYS, "part", "start_us", "end_us", "sampled_us", title.alias("title")), most_us)
    low, high = F.greatest("start_us", "block"), F.least(F.col("end_us"), F.col("block") + most_us)
    us = F.col("sampled_us").cast("double") * (high - low) / (F.col("end_us") - F.col("start_us"))
    per = cut.where("title <> ''").groupBy(*KEYS, "part", "block", "title").agg(F.sum(us).alias("us"), F.min(low).alias("seen"))
    w = Window.partitionBy(*KEYS, "part", "block")
    told = per.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("us"), "seen")).cast("long"), "windows": F.count(F.lit(1)).over(w), "start_us": F.min("seen").over(w)})
    return told.where(F.col("rank") <= k).select(*KEYS, "start_us", "title", "us", "rank", "windows")


def episodes(runs: DataFrame, most_us: int = BLOCK, jitter_us: int = MERGE_GAP) -> DataFrame:
    """Runs of one state, app and window, jitter_us apart at most, in episodes of most_us at most; support stays exact."""
    w = ordered(KEYS, "start_us")
    told = islands(runs.withColumn("new", _changes(["state", "app", "win"], jitter_us, w)), KEYS, F.col("new"), "start_us", into="part")
    return _blocks(told.select(*KEYS, "part", "start_us", "end_us", "state", "app", "win"), most_us, ["state", "app", "win"])


def day_windows(segs: DataFrame, k: int = 20) -> DataFrame:
    """The k (app, title) with most sampled time by device and day, of equal ones the first seen; sensitive titles are one."""
    title = F.when(is_sensitive(F.col("win")), "[sensitive window]").otherwise(F.col("win"))
    t = segs.where("state = 'active'").groupBy(*KEYS, "app", title.alias("title")).agg(F.sum("sampled_us").alias("us"), F.min("start_us").alias("seen"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("us"), "seen")).cast("long")
    return t.withColumn("rank", rank).where(F.col("rank") <= k).drop("seen")


def switch_rates(segs: DataFrame) -> DataFrame:
    """Window and app switches of the foreground by device and day, and both an hour of sampled time, in thousandths.

    A switch is a change from one foreground segment to the next of the day; the rate is made of sums, never averaged.
    """
    w = ordered(KEYS, "start_us")
    front = segs.where("state = 'active'").withColumns({c: (~F.lag(x).over(w).eqNullSafe(F.col(x)) & (F.row_number().over(w) > 1)).cast("long") for c, x in (("app_moved", "app"), ("win_moved", "win"))})
    moved = F.greatest("app_moved", "win_moved")
    told = front.groupBy(*KEYS).agg(F.sum(moved).alias("window_switches"), F.sum("app_moved").alias("app_switches"), F.sum("sampled_us").alias("us"))
    return told.withColumn("switches_per_hour_x1000", F.expr(f"CASE WHEN us > 0 THEN window_switches * 1000 * {HOUR} div us END"))


def switch_rates_of_periods(days: DataFrame) -> DataFrame:
    """switch_rates() of whole devices: switches and seconds are added, the rate is made anew."""
    told = days.groupBy("device").agg(F.count(F.lit(1)).alias("days"), *[F.sum(c).alias(c) for c in ("window_switches", "app_switches", "us")])
    return told.withColumn("switches_per_hour_x1000", F.expr(f"CASE WHEN us > 0 THEN CAST(window_switches AS DECIMAL(38, 0)) * 1000 * {HOUR} div us END"))


def bounded_episodes(runs: DataFrame, boundaries: DataFrame, most_us: int = BLOCK, jitter_us: int = MERGE_GAP) -> DataFrame:
    """episodes() that explicit boundaries and barriers end as well, each with a digest of what supports it as its id.

    boundaries (device, at_us) cut runs and end an episode, also where they fall between two runs. A run with `barrier` is
    an episode of its own. The digest covers state, app, window and every piece of support, so it names the content.
    """
    own = runs.select(*KEYS, "id", "state", "app", "win", "barrier", "start_us", "end_us")
    marks = boundaries.select("device", "at_us").distinct()
    met = point_join(marks, own.select("device", "day", "id", "start_us", "end_us"), ["device"]).where("at_us > start_us")
    cuts = met.groupBy(*KEYS, "id").agg(F.array_sort(F.collect_set("at_us")).alias("cuts"))
    told = own.join(cuts, [*KEYS, "id"], "left").withColumn("edges", F.concat(F.array("start_us"), F.coalesce("cuts", F.array().cast("array<long>")), F.array("end_us")))
    each = told.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("edges") - 1))).withColumns({"start_us": F.element_at("edges", F.col("i")), "end_us": F.element_at("edges", F.col("i") + 1)}).drop("edges", "cuts", "i")
    last = asof(each, marks.select("device", F.col("at_us").alias("start_us"), "at_us", F.col("at_us").alias("id")), ["device"], "start_us", [])
    w = ordered(KEYS, "start_us")
    split = F.coalesce(F.col("match_us") >= F.lag("end_us").over(w), F.lit(False)) | F.col("barrier") | F.coalesce(F.lag("barrier").over(w), F.lit(False))
    parts = islands(last.withColumn("new", _changes(["state", "app", "win"], jitter_us, w) | split), KEYS, F.col("new"), "start_us", into="part")
    cut = _pieces(parts.select(*KEYS, "part", "state", "app", "win", "start_us", "end_us"), most_us)
    low, high = F.greatest("start_us", "block"), F.least(F.col("end_us"), F.col("block") + most_us)
    support = F.array_sort(F.collect_list(F.struct(low.alias("start_us"), high.alias("end_us"))))  # an episode lasts most_us at most
    found = cut.groupBy(*KEYS, "part", "block").agg(F.min(low).alias("start_us"), F.max(high).alias("end_us"), F.sum(high - low).alias("us"), F.first("state").alias("state"), F.first("app").alias("app"), F.first("win").alias("win"), support.alias("support"))
    spans = F.array_join(F.transform("support", lambda s: F.concat(s["start_us"].cast("string"), F.lit("-"), s["end_us"].cast("string"))), ",")
    content = F.concat_ws("|", F.col("device").cast("string"), "state", F.coalesce("app", F.lit("")), F.coalesce("win", F.lit("")), spans)
    return found.select(*KEYS, "start_us", "end_us", "us", "state", "app", "win", F.concat(F.lit("episode-"), F.sha2(content, 256)).alias("episode_id"))


def activity_score(runs: DataFrame, sessions: DataFrame, screens: DataFrame, now_us: int, zone: Column | str = "UTC", step_us: int = 5 * MINUTE) -> DataFrame:
    """All bins of each local day that has runs: the computer's state, its time and topic, the topic seen on its screen, and
    the phone's time and app.

    A bin that begins at now_us or later is `future`. runs need `topic`; screens are (device, at_us, topic) and count only
    where some time has no title. Phone time is a union; its app is the one with most time. Ties go to what was first
    seen, then by name.
    """
    length = F.col("end_us") - F.col("start_us")
    days = day_spans(runs, KEYS, zone)
    spine = days.select("device", "day", F.explode(F.sequence(F.floor(F.col("low_us") / step_us), F.floor((F.col("high_us") - 1) / step_us))).alias("slot"))
    sums = activity_bins(runs, step_us)

    def most(rows: DataFrame, label: str, value: Column, into: str) -> DataFrame:
        per = rows.where(F.col(label).isNotNull()).groupBy("device", "slot", label).agg(value.alias("v"), F.min("start_us").alias("seen"))
        return per.groupBy("device", "slot").agg(F.min_by(label, F.struct(-F.col("v"), "seen", label)).alias(into))

    topics = most(cut(runs.where("state = 'active'"), step_us), "topic", F.sum(length), "topic")
    phone = cut(sessions, step_us)
    own = union_us(phone, ["device", "slot"], "phone_us")
    apps = most(phone, "app", F.sum(length), "phone_app")
    seen = most(screens.withColumns({"slot": F.floor(F.col("at_us") / step_us), "start_us": F.col("at_us")}), "topic", F.count(F.lit(1)), "screen_topic")
    wide = spine
    for part in (sums.drop("top_app"), topics, own, apps, seen):
        wide = wide.join(part, ["device", "slot"], "left")
    state = F.when(F.col("slot") * step_us >= now_us, "future").otherwise(F.coalesce("state", F.lit("unknown")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    shown = F.when(zero("unattributed_us") > 0, F.col("screen_topic"))
    return wide.select("device", "day", "slot", state.alias("state"), zero("active_us").alias("active_us"), zero("unattributed_us").alias("unattributed_us"), "topic", shown.alias("screen_topic"), zero("phone_us").alias("phone_us"), "phone_app")


def window_totals(segs: DataFrame, k: int = 20) -> DataFrame:
    """The k (app, window) with most time by device; of equal ones the first seen."""
    t = segs.where("state = 'active'").groupBy("device", "app", "win").agg(F.sum("sampled_us").alias("us"), F.min("start_us").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("device").orderBy(F.desc("us"), "seen")).cast("long")
    return t.withColumn("rank", rank).where(F.col("rank") <= k).drop("seen")


def browser_overlap(tabs: DataFrame, segs: DataFrame) -> DataFrame:
    """Time by site: a tab event lasts until the next one of its device and day, and counts where the app is in front."""
    w = ordered(KEYS, "start_us", "id")
    lasting = tabs.withColumn("end_us", F.lead("start_us").over(w)).where("end_us > start_us AND focused")
    front = segs.where("state = 'active' AND app = 'app1'").select(*KEYS, "start_us", "end_us")
    met = overlap_join(lasting.select(*KEYS, "start_us", "end_us", "site"), front, KEYS)
    return met.groupBy("device", "site").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))


def browser_shares(tabs: DataFrame, segs: DataFrame, app: str = "chrome") -> DataFrame:
    """Sampled time by device and site: a tab counts from its event to the next one, or to the end of its day, where a
    browser's segment is in front, with or without a title, by the share of the segment that was sampled.

    An event without focus or site only ends the one before. Merged segments hold gaps, so their wall time is not credited.
    """
    w = ordered(KEYS, "start_us", "id")
    lasting = tabs.withColumn("end_us", F.coalesce(F.lead("start_us").over(w), (F.col("day") + 1) * DAY)).where("end_us > start_us AND focused AND site IS NOT NULL")
    front = segs.where(F.col("state").isin("active", "unattributed") & F.contains(F.lower("app"), F.lit(app))).select(*KEYS, "start_us", "end_us", "sampled_us")
    met = overlap_join(lasting.select(*KEYS, "start_us", "end_us", "site"), front, KEYS)
    share = (F.col("end_us") - F.col("start_us")).cast("double") * F.col("sampled_us") / (F.col("b_end") - F.col("b_start"))
    return met.groupBy("device", "site").agg(F.sum(share).alias("us"))
