"""Corrections and outcomes as tables, capacity and telemetry of runs, and health of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.time import DAY
from spanloom.operators.interval import overlap_join, with_same


def apply_corrections(commands: DataFrame, keys: list[str]) -> DataFrame:
    """Current labels from a command log (op set or clear, label, at_us, id): the last one decides.

    The scope is frozen at the first `set`, whose time is first_us.
    """
    told = commands.where("op IN ('set', 'clear')")
    last = told.groupBy(*keys).agg(F.max_by(F.struct("op", "label"), F.struct("at_us", "id")).alias("l"), F.min(F.when(F.col("op") == "set", F.col("at_us"))).alias("first_us"))
    return last.where("l.op = 'set'").select(*keys, F.col("l.label").alias("label"), "first_us")


def active_outcomes(commands: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes (op mark) of labels that are current: a change of label retracts those before it."""
    w = Window.partitionBy(*keys).orderBy("at_us", "id")
    sets = commands.where("op = 'set'").withColumn("before", F.lag("label").over(w))
    epoch = sets.where(~F.col("before").eqNullSafe(F.col("label"))).groupBy(*keys).agg(F.max("at_us").alias("epoch"))
    now = apply_corrections(commands, keys).select(*keys).join(epoch, keys)
    return commands.where("op = 'mark'").join(now, keys).where("at_us >= epoch").groupBy(*keys).agg(F.count(F.lit(1)).alias("outcomes"))


def stable_ids(blocks: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """A block keeps its earlier id if its keys are unchanged; others get a digest."""
    own = F.substr(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), F.lit(1), F.lit(12))
    return blocks.join(prior.select(*keys, "prior_id"), keys, "left").withColumn("block_id", F.coalesce("prior_id", own)).drop("prior_id")


def night_capacity(receipts: DataFrame, window_s: int) -> DataFrame:
    """By night: runs once by start, sums, and how many attempts a window of window_s holds at that pace."""
    best = F.max_by(F.struct("night", "completed", "failed", "elapsed_cs"), F.struct("completed", "failed", "elapsed_cs"))
    one = receipts.groupBy("started_us").agg(best.alias("r")).select("r.*")
    sums = one.groupBy("night").agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in ("completed", "failed", "elapsed_cs")])
    sums = sums.withColumn("attempts", F.col("completed") + F.col("failed"))
    return sums.withColumn("capacity", F.expr(f"CASE WHEN elapsed_cs > 0 THEN {window_s} * 100 * attempts div elapsed_cs END"))


def conservative(nights: DataFrame, least_attempts: int, n: int) -> DataFrame:
    """The lowest capacity of the last n nights with enough attempts."""
    last = nights.where(F.col("attempts") >= least_attempts).orderBy(F.desc("night")).limit(n)
    return last.agg(F.min("capacity").alias("capacity"), F.count(F.lit(1)).alias("nights"))


def model_benchmark(rows: DataFrame, window_s: int, share: float) -> DataFrame:
    """By model: rows, median, nearest-rank 90th percentile, and frames that a window holds at that pace."""
    m = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.median("elapsed_s").alias("median_s"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY elapsed_s)").alias("p90_s"))
    return m.withColumn("capacity", F.floor(F.lit(window_s * share) / F.col("p90_s")))


def combined(annotations: DataFrame) -> DataFrame:
    """Each frame over several runs: done if any run completed it, held if any filtered it."""
    return annotations.groupBy("path").agg(F.bool_or(F.col("status") == "complete").alias("done"), F.bool_or(F.col("status") == "filtered").alias("held"))


def numbered(rows: DataFrame, keys: list[str], at: str, tie: str, into: str = "n") -> DataFrame:
    """rows with their number, from 0, in time order of their keys: days are counted first, so each is ranked on its own."""
    told = rows.withColumn("__day", F.floor(F.col(at) / DAY))
    w = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    base = told.groupBy(*keys, "__day").agg(F.count(F.lit(1)).alias("__rows")).select(*keys, "__day", F.coalesce(F.sum("__rows").over(w), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*keys, "__day").orderBy(at, tie)) - 1
    return with_same(told.withColumn("__own", own), base, [*keys, "__day"]).withColumn(into, F.col("__base") + F.col("__own")).drop("__day", "__own", "__base")


def identity_health(samples: DataFrame, share: int = 80, recent: int = 60, least: int = 24, chunk: int = 4096) -> DataFrame:
    """Each sample with the health of titles in its device's last `recent` ones (device, id, start_us, state).

    Of these, windows are active or unattributed, and the unattributed have no title. status, by rank: permission_blocked
    (windows, but no screen_access), needs_review (all of the last are untitled windows, or `least` windows or more of
    which `share` per cent are untitled), permission_limited (no ax_access), normal. Runs of `chunk` samples are windows of
    their own, with the samples before that they need.
    """
    told = numbered(samples, ["device"], "start_us", "id")
    at = F.floor(F.col("n") / chunk)
    told = told.withColumn("part", F.explode(F.when(F.pmod("n", F.lit(chunk)) > chunk - recent, F.array(at, at + 1)).otherwise(F.array(at))))
    w = Window.partitionBy("device", "part").orderBy("n").rowsBetween(1 - recent, 0)
    window, untitled = F.col("state").isin("active", "unattributed").cast("long"), (F.col("state") == "unattributed").cast("long")
    told = told.withColumns({"windows": F.sum(window).over(w), "untitled": F.sum(untitled).over(w)}).where(at == F.col("part"))
    status = (
        F.when((F.col("windows") > 0) & ~F.col("screen_access"), "permission_blocked")
        .when((F.col("untitled") >= recent) | (F.col("windows") >= least) & (F.col("untitled") * 100 >= F.col("windows") * share), "needs_review")
        .when(~F.col("ax_access"), "permission_limited")
        .otherwise("normal")
    )
    return told.withColumn("status", status).drop("n", "part")


def counter_rates(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Rates between readings of a counter; null at the first one and after a reset."""
    w = Window.partitionBy(*keys).orderBy(at, "id")
    v, t = F.lag(value).over(w), F.lag(at).over(w)
    return rows.withColumn("per_us", F.when(v.isNotNull() & (F.col(value) >= v), (F.col(value) - v) / (F.col(at) - t)))


def fallback_candidates(source: DataFrame, fallback: DataFrame, readable: DataFrame, status: str) -> DataFrame:
    """Frames (path) whose source annotation has `status`, whose text was read, and that the fallback neither completed nor
    skipped nor tried twice: with its last status and attempts. source, fallback: path, status (attempts); readable: path."""
    tried = fallback.select("path", F.col("status").alias("fallback"), "attempts")
    met = source.where(F.col("status") == status).select("path").join(readable.select("path"), "path", "left_semi").join(tried, "path", "left")
    open_ = F.col("fallback").isNull() | ~F.col("fallback").isin("complete", "sensitive_skipped") & (F.col("attempts") < 2)
    return met.where(open_).select("path", "fallback", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"))


def review_view(slots: DataFrame, unknown: DataFrame, scopes: DataFrame, outcomes: DataFrame, topics: DataFrame, step_us: int) -> DataFrame:
    """Slots to review with what is known of them: (device, slot, unknown_us, confirmed_label, scope_label, confirmed_us,
    unconfirmed_us, suggested_label, outcome_marked).

    slots: device, slot, unknown_us; unknown: disjoint runs (device, start_us, end_us) of unknown time; scopes: device, slot,
    label, start_us, end_us of current corrections; outcomes: device, slot; topics: device, at_us, topic. A label counts as
    confirmed only if its frozen scope covers all of the slot's unknown time. The suggestion is the commonest topic in the
    slot, of equal ones the first seen, then by name.
    """
    held = overlap_join(scopes.select("device", "slot", "start_us", "end_us"), unknown.select("device", "start_us", "end_us"), ["device"])
    covered = held.groupBy("device", "slot").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("covered_us"))
    per = topics.withColumn("slot", F.floor(F.col("at_us") / step_us)).groupBy("device", "slot", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("at_us").alias("seen"))
    suggested = per.groupBy("device", "slot").agg(F.min_by("topic", F.struct(-F.col("n"), "seen", "topic")).alias("suggested_label"))
    told = slots.join(scopes.select("device", "slot", F.col("label").alias("scope_label")), ["device", "slot"], "left").join(covered, ["device", "slot"], "left").join(suggested, ["device", "slot"], "left")
    told = told.join(outcomes.select("device", "slot").distinct().withColumn("outcome_marked", F.lit(True)), ["device", "slot"], "left")
    confirmed = F.least(F.coalesce("covered_us", F.lit(0)), "unknown_us")
    label = F.when(F.col("scope_label").isNotNull() & (F.col("confirmed_us") >= F.col("unknown_us")), F.col("scope_label"))
    told = told.withColumn("confirmed_us", confirmed).withColumn("confirmed_label", label)
    return told.select("device", "slot", "unknown_us", "confirmed_label", "scope_label", "confirmed_us", (F.col("unknown_us") - F.col("confirmed_us")).alias("unconfirmed_us"), "suggested_label", F.coalesce("outcome_marked", F.lit(False)).alias("outcome_marked"))


def frame_counts(frames: DataFrame, annotations: DataFrame, day: Column) -> DataFrame:
    """By day of a frame: frames, those whose text is read, those still pending, and annotations by status.

    frames: id, status (of reading its text), and what `day` needs; annotations: id, status. One row a day; a status that no
    annotation of the day has is 0.
    """
    dated = frames.select("id", "status", day.alias("day"))
    own = dated.groupBy("day").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("status") == "complete").alias("read"), F.count_if(~F.col("status").eqNullSafe("complete")).alias("pending"))
    told = annotations.select("id", F.col("status").alias("told")).join(dated.select("id", "day"), "id").groupBy("day").agg(*[F.count_if(F.col("told") == s).alias(s) for s in ("complete", "incomplete", "filtered")])
    return own.join(told, "day", "left").select("day", "frames", "read", "pending", *[F.coalesce(s, F.lit(0)).alias(s) for s in ("complete", "incomplete", "filtered")])


def frame_intervals(benchmark: DataFrame, hours: tuple[int, ...] = (8, 10, 12)) -> DataFrame:
    """A benchmark (capacity) with the least seconds between frames, so that all of so many active hours are described."""
    return benchmark.withColumns({f"seconds_{h}h": F.when(F.col("capacity") > 0, F.ceil(F.lit(h * 3600) / F.col("capacity"))) for h in hours})
