"""Evaluation of models on frames: cohorts, splits, reviews, metrics by variant, telemetry and training exports."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.time import DAY, SECOND
from spanloom.operators.components import components, meet
from spanloom.operators.evidence import hamming_pairs
from spanloom.operators.fold import with_episode
from spanloom.operators.interval import union_us, with_same
from spanloom.operators.rank import numbered
from spanloom.sources.scratch import removed, written


def _sum(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def greedy_exclusion(rows: DataFrame, most: int = 4, bits: int = 64) -> DataFrame:
    """rows (id, ord, code) with `kept`: taken in order of ord and id, a row goes if its code is within `most` bits of one
    kept before.

    What an earlier row's fate settles needs no order of its own: in each round every row without an open or kept earlier
    neighbour is kept, and its later neighbours go. Rounds are as many as the longest chain of open neighbours.
    """
    # A code that repeats goes with the first of its rows or with what removes that one, so one row a code is looked at.
    told = rows.groupBy("code").agg(F.min(F.struct("ord", "id")).alias("o")).select("o.id", "o", "code")
    pairs = hamming_pairs(told.select("id", "code"), most, bits)
    a, b = told.select(F.col("id").alias("a"), F.col("o").alias("ao")), told.select(F.col("id").alias("b"), F.col("o").alias("bo"))
    met = pairs.join(a, "a").join(b, "b")
    first = F.col("ao") < F.col("bo")
    edges = written(met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")))
    state = written(edges.select(F.explode(F.array("early", "late")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept IS NULL").isEmpty():
        before = state.select(F.col("id").alias("early"), F.col("kept").alias("early_kept"))
        told_ = edges.join(before, "early").groupBy(F.col("late").alias("id")).agg(F.bool_or(F.coalesce("early_kept", F.lit(False))).alias("gone"), F.bool_or(F.col("early_kept").isNull()).alias("open"))
        fate = F.when(F.coalesce("gone", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        new = written(state.join(told_, "id", "left").select("id", F.coalesce("kept", fate).alias("kept")))
        removed(state)
        state = new
    first = told.select("id", F.lit(True).alias("__first"))
    return rows.join(first, "id", "left").join(state, "id", "left").withColumn("kept", F.coalesce("__first", F.lit(False)) & F.coalesce("kept", F.lit(True))).drop("__first")


def whole_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (id) with `group`: the smallest id among all rows that shared values of any key link to each other."""
    each = [rows.where(F.col(k).isNotNull()).select("id", F.xxhash64(F.lit(k), F.col(k).cast("string")).alias("key")) for k in keys]
    links = reduce(DataFrame.unionByName, each)
    first = links.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # A key's rows are linked to its first one, not to each other.
    found = components(meet(links, first, "key", "n", links.count()).select(F.col("id").alias("u"), F.col("first").alias("v")))
    return rows.join(found.select(F.col("u").alias("id"), "root"), "id", "left").withColumn("group", F.coalesce("root", "id")).drop("root")


#: Sums that fill() looks at one by one; of a larger target, whole sizes are taken first, the largest ones.
SUMS = 1 << 22


def fill(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size (size: count) add up to the largest total that is at most target.

    Counts are split into 1, 2, 4, ... groups; of each sum, the first part with which it can be reached is kept, so the way
    back names each part once. Above SUMS, sizes are taken whole from the largest on until about SUMS are open, and the rest
    is filled exactly.
    """
    taken, rest = dict.fromkeys(sizes, 0), target
    for size in sorted(sizes, reverse=True):
        k = min(sizes[size], max(0, rest - SUMS) // size)
        taken[size], rest = k, rest - k * size
    parts = []
    for size in sorted(sizes):
        left, k = sizes[size] - taken[size], 1
        while left > 0 and size <= rest:
            parts.append((size, min(k, left)))
            left, k = left - k, 2 * k
    reached, first = np.zeros(rest + 1, dtype=bool), np.zeros(rest + 1, np.int32)
    reached[0] = True
    for i, (size, k) in enumerate(parts):
        step = size * k
        if reached[rest] or step > rest:
            continue
        new = np.flatnonzero(reached[:-step] & ~reached[step:]) + step
        reached[new], first[new] = True, i
    at = int(np.flatnonzero(reached)[-1])
    while at:
        size, k = parts[first[at]]
        taken[size] += k
        at -= size * k
    return {size: k for size, k in taken.items() if k}


def hold_out(rows: DataFrame, share: float) -> DataFrame:
    """Rows (id, group) with `held`: whole groups that fill `share` of all rows as far as their sizes allow.

    Only the histogram of group sizes comes to the driver, a row by size. Of a size, the first groups by md5 are held.
    """
    target = int(rows.count() * share)
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= target).withColumn("md5", F.md5(F.col("group").cast("string")))
    plan = fill({r["n"]: r["count"] for r in groups.groupBy("n").count().collect()}, target)
    if not plan:
        return rows.withColumn("held", F.lit(False))
    ranked = numbered(groups, ["n"], ["md5", "group"], [F.substr("md5", F.lit(1), F.lit(3))], "place")
    chosen = rows.sparkSession.createDataFrame(sorted(plan.items()), "n long, k long")
    held = ranked.join(chosen, "n").where("place <= k").select("group", F.lit(True).alias("held"))
    return rows.join(held, "group", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def middle_turn(pos: Column, n: Column) -> Column:
    """When a row at a place from 0 of n is taken if the middle one of what is left is, again and again."""
    d = pos - F.floor(n / 2)
    odd = F.when(d > 0, 2 * d - 1).otherwise(-2 * d)
    return F.when(n % 2 == 1, odd).otherwise(F.when(d < 0, -2 * d - 1).otherwise(2 * d))


#: Turns in one lot of a ranking by turns.
TURNS = 1024


def specialization_split(frames: DataFrame, today: int, quotas: dict[str, int], most_bits: int = 4) -> DataFrame:
    """Frames for training and the held-out parts: (id, day, split, episode, ord).

    frames: id, device, at_us, day (local), app, win, code (64 bits), ok (text read, nothing sensitive). Of the days before
    today the last one tests, the one before validates, the others train. Episodes with frames in two parts are left out. Of
    each context in each half hour the middle frame is a candidate; apps take turns, from the middle of their time outwards.
    In the order test, validation, train a frame goes if its code is within most_bits of one selected before; the first
    `quotas` of each part stay. Fewer than three days raise.
    """
    # Each step is written before the next looks at it twice, so that plans stay small: the driver holds all of one.
    told = written(with_episode(written(frames.select("id", "device", "at_us", "day", "app", "win", "code", "ok")), ["device"], ["app", "win"]))
    days = [r.day for r in told.where(F.col("day") < today).select("day").distinct().orderBy(F.desc("day")).limit(3).collect()]
    if len(days) < 3:
        raise ValueError("three whole days are needed")
    split = F.when(F.col("day") == days[0], "test").when(F.col("day") == days[1], "validation").when(F.col("day") < today, "train")
    told = told.withColumn("split", split)
    crossing = told.where("split IS NOT NULL").groupBy("device", "episode").agg(F.count_distinct("split").alias("n")).where("n > 1").select("device", "episode")
    fit = told.where("split IS NOT NULL AND ok").join(crossing, ["device", "episode"], "left_anti")
    group = ["day", "app", "win", "half"]
    fit = fit.withColumn("half", F.floor(F.col("at_us") / (1800 * SECOND)))
    w = Window.partitionBy(*group)
    one = fit.withColumns({"r": F.row_number().over(w.orderBy("at_us", "id")), "n": F.count(F.lit(1)).over(w)}).where(F.col("r") == F.floor(F.col("n") / 2) + 1)
    one = written(one.select("id", "at_us", "day", "app", "split", "episode", "code"))
    first = one.groupBy("split", "app").agg(F.min(F.struct("at_us", "id")).alias("first"))
    one = with_same(numbered(one, ["split", "app"], ["at_us", "id"], [F.floor(F.col("at_us") / DAY)], "pos", "n"), first, ["split", "app"])
    ranked = numbered(written(one.withColumn("turn", middle_turn(F.col("pos") - 1, F.col("n")))), ["split"], ["turn", "first"], [F.floor(F.col("turn") / TURNS)], "ord")
    ranked = written(ranked.select("id", "day", "split", "episode", "code", "ord"))
    rows = {r.split: r["count"] for r in ranked.groupBy("split").count().collect()}
    parts: list[DataFrame] = []
    for name in ("test", "validation", "train"):
        before = [p.select("id", F.lit(0).cast("long").alias("ord"), "code") for p in parts]
        size, found = 16 * quotas[name], None
        # A row's fate hangs on rows before it alone, so of the first rows the same ones stay as of all: more are taken until
        # the part is full or no row is left.
        while found is None or len(found.head(quotas[name])) < quotas[name] and size < rows.get(name, 0):
            if found is not None:
                removed(found)
                size *= 4
            own = ranked.where((F.col("split") == name) & (F.col("ord") <= size))
            kept = greedy_exclusion(reduce(DataFrame.unionByName, [own.select("id", "ord", "code"), *before]), most_bits).where("kept").select("id")
            found = written(own.join(kept, "id", "left_semi").orderBy("ord").limit(quotas[name]))
        parts.append(found)
    chosen = reduce(DataFrame.unionByName, parts)
    return chosen.drop("code")


def cohort(frames: DataFrame, reason: Column, key: str, quota: int) -> DataFrame:
    """The frames of each key that a trial asks about: (key, id, bin, episode, rank), at most `quota`.

    Frames: key, id, bin (half hour), episode, seconds (what they could explain). Of eligible ones (reason ok), each bin
    visits different episodes before it takes one twice, longer ones first; bins take turns.
    """
    ok = frames.where(reason == "ok")
    turn = F.row_number().over(Window.partitionBy(key, "bin", "episode").orderBy(F.desc("seconds"), "id"))
    within = F.row_number().over(Window.partitionBy(key, "bin").orderBy("turn", F.desc("seconds"), "id"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("within", "bin")).cast("long")
    return ok.withColumn("turn", turn).withColumn("within", within).withColumn("rank", rank).where(F.col("rank") <= quota).select(key, "id", "bin", "episode", "rank")


def coverage(cohort_: DataFrame, results: DataFrame, eligible: DataFrame, occupied: DataFrame, key: str) -> DataFrame:
    """By key: what of a frozen cohort was described, without a word on whether rightly.

    cohort_: key, id, bin, episode, start_us, end_us. results: id, status, claims (whether a supported claim is made).
    eligible and occupied: key, bin. Shares are parts of a million, null where there is nothing to cover.
    """
    met = cohort_.join(results, "id", "left")
    done = F.col("status") == "complete"
    sums = met.groupBy(key).agg(
        F.count(F.lit(1)).alias("selected"), _sum(done).alias("completed"), _sum(~F.col("status").isin("complete", "running")).alias("failed"),
        _sum(F.col("status").isNull() | (F.col("status") == "running")).alias("pending"), F.count_distinct(F.when(done, F.col("episode"))).alias("episodes"),
    )
    spans = lambda c, name: union_us(met.where(c), [key], name)
    bins = met.where(done).select(key, "bin").distinct()

    def share(of: DataFrame, name: str) -> DataFrame:
        both = of.select(key, "bin").distinct().join(bins.withColumn("__d", F.lit(True)), [key, "bin"], "left")
        return both.groupBy(key).agg(F.floor(F.count("__d") * 1_000_000 / F.count(F.lit(1))).alias(name))

    out = sums.join(spans(done, "support_us"), key, "left").join(spans(done & F.col("claims"), "claimed_us"), key, "left")
    out = out.join(share(eligible, "eligible_ppm"), key, "left").join(share(occupied, "observed_ppm"), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("support_us", "claimed_us")})


GRADES = ("project_correct", "task_correct", "evidence_supported", "uncertainty_appropriate")


def assessment_totals(results: DataFrame, grades: DataFrame) -> DataFrame:
    """By variant: totals of reviewed results, and whether the review is whole.

    results: example, variant, status, output. grades: example, variant, output (as it was graded), the GRADES,
    privacy_leak, unsupported_completion, unsupported_claims. A result counts as reviewed if its grades are all there and
    for this very output; a failure that got a correct grade makes the review invalid.
    """
    g = grades.select("example", "variant", F.col("output").alias("__o"), *GRADES, "privacy_leak", "unsupported_completion", "unsupported_claims")
    met = results.join(g, ["example", "variant"], "left")
    whole = F.col("__o").eqNullSafe(F.col("output"))
    for c in (*GRADES, "privacy_leak", "unsupported_completion", "unsupported_claims"):
        whole = whole & F.col(c).isNotNull()
    done = F.col("status") == "complete"
    any_right = F.lit(False)
    for c in GRADES:
        any_right = any_right | F.col(c)
    met = met.withColumns({"whole": whole, "invalid": whole & ~done & F.coalesce(any_right, F.lit(False))})
    ok = F.col("whole") & ~F.col("invalid")
    return met.groupBy("variant").agg(
        F.count(F.lit(1)).alias("selected"), _sum(done).alias("complete"), _sum(ok).alias("reviewed"), _sum(F.col("invalid")).alias("invalid"), F.bool_and(ok).alias("whole"),
        _sum(ok & done & F.col("project_correct") & F.col("task_correct") & F.col("evidence_supported")).alias("joint_correct"),
        _sum(ok & ~F.col("evidence_supported")).alias("evidence_errors"), _sum(ok & ~F.col("uncertainty_appropriate")).alias("uncertainty_errors"),
        _sum(ok & F.col("privacy_leak")).alias("privacy_leaks"), _sum(ok & F.col("unsupported_completion")).alias("completion_claims"),
        F.sum(F.when(ok, F.col("unsupported_claims")).otherwise(0)).alias("unsupported_claims"),
    )


def variant_report(examples: DataFrame, results: DataFrame, variants: list[int]) -> DataFrame:
    """By variant, with every selected example in the denominators, attempted or not.

    examples: example, episode, bin, truth (null: unanswerable). results: example, variant, attempted, status, guess (null:
    abstained), raw_available, privacy, elapsed. Shares are parts of a million, null without a denominator; privacy flags
    are null for a variant whose raw output was never available.
    """
    spark = examples.sparkSession
    asked = examples.join(F.broadcast(spark.createDataFrame([(v,) for v in variants], "variant long")))  # one row a variant
    met = asked.join(results, ["example", "variant"], "left")
    done, right = F.col("status") == "complete", F.col("guess").eqNullSafe(F.col("truth"))
    tried = F.coalesce("attempted", F.lit(False))
    told = F.col("guess").isNotNull()
    ppm = lambda a, b: F.floor(F.try_divide((F.col(a) * 1_000_000).cast("double"), F.col(b).cast("double"))).alias
    m = met.groupBy("variant").agg(
        F.count(F.lit(1)).alias("selected"), _sum(tried).alias("attempted"), _sum(done).alias("complete"), _sum(F.col("status").isNotNull() & ~done).alias("failed"), _sum(F.col("status").isNull()).alias("pending"),
        _sum(done & right).alias("correct"), _sum(done & told).alias("asserted"), _sum(done & told & right).alias("asserted_right"),
        _sum(F.col("truth").isNotNull()).alias("answerable"), _sum(F.col("truth").isNull()).alias("unanswerable"), _sum(done & ~told & F.col("truth").isNull()).alias("right_abstentions"),
        _sum(tried & F.col("raw_available")).alias("raw_available"), _sum(tried & F.col("privacy")).alias("flags"), F.sum(F.when(tried, F.col("elapsed"))).alias("total_s"),
        F.median(F.when(done, F.col("elapsed"))).alias("median_s"), F.count_distinct(F.when(done, F.col("episode"))).alias("episodes"), F.count_distinct(F.when(done, F.col("bin"))).alias("bins"),
    )
    return m.select(
        "variant", "selected", "attempted", "complete", "failed", "pending", "correct",
        ppm("asserted_right", "asserted")("precision_ppm"), ppm("asserted_right", "answerable")("recall_ppm"), ppm("right_abstentions", "unanswerable")("abstention_ppm"),
        "right_abstentions", F.when(F.col("raw_available") > 0, F.col("flags")).alias("privacy_flags"), "total_s", "median_s", "episodes", "bins",
    )


def nominate_variant(rounds: DataFrame, base: int, gain_percent: int = 15) -> DataFrame:
    """The cheapest variant that is gain_percent faster than the base in every round and in none of them worse, else the base.

    rounds: variant, round, cost, correct, critical (flags that must not be).
    """
    b = rounds.where(F.col("variant") == base).select("round", F.col("cost").alias("b_cost"), F.col("correct").alias("b_correct"))
    met = rounds.where(F.col("variant") != base).join(b, "round")
    ok = (F.col("cost") * 100 <= F.col("b_cost") * (100 - gain_percent)) & (F.col("correct") >= F.col("b_correct")) & (F.col("critical") == 0)
    fit = met.groupBy("variant").agg(F.bool_and(ok).alias("ok"), F.sum("cost").alias("total")).where("ok")
    best = fit.agg(F.min_by(F.struct("variant", "total"), F.struct("total", "variant")).alias("b"))
    own = rounds.where(F.col("variant") == base).agg(F.sum("cost").alias("own"))
    return best.join(F.broadcast(own)).select(F.coalesce("b.variant", F.lit(base).cast("long")).alias("variant"), F.coalesce("b.total", "own").alias("total"))  # one row each


def generation_scores(gold: DataFrame, guessed: DataFrame, fields: list[str]) -> DataFrame:
    """How generations compare with gold by example: each field, all fields, the cited evidence as a set, and abstentions
    where gold has none and where it has one. gold and guessed: example, the fields, evidence (array)."""
    other = guessed.select("example", *[F.col(f).alias(f"__{f}") for f in fields], F.array_sort(F.array_distinct("evidence")).alias("__evidence"))
    met = gold.join(other, "example", "left")
    same = {f: F.col(f).eqNullSafe(F.col(f"__{f}")) & F.col("__evidence").isNotNull() for f in fields}
    joint = F.lit(True)
    for c in same.values():
        joint = joint & c
    evidence = F.coalesce(F.array_sort(F.array_distinct("evidence")) == F.col("__evidence"), F.lit(False))
    abstained = F.col("__evidence").isNotNull() & F.col(f"__{fields[0]}").isNull()
    return met.agg(
        F.count(F.lit(1)).alias("n"), *[_sum(c).alias(f"field_{f}") for f, c in same.items()], _sum(joint).alias("joint"), _sum(evidence).alias("evidence"),
        _sum(abstained & F.col(fields[0]).isNull()).alias("right_abstentions"), _sum(abstained & F.col(fields[0]).isNotNull()).alias("missed"),
    )


def telemetry_groups(attempts: DataFrame) -> DataFrame:
    """Attempts by stage, engine, variant and a digest of their identity: dispositions, times and load.

    attempts: stage, engine, variant, identity, status, result_status, process_s, elapsed_s, cores, samples (array of
    cpu of one core, gpu of the device, in per cent). Complete is process and result; a startup whose result is declared not
    applicable is no failure; a status that is not there is unknown, not failed. Measures that are not finite or negative are
    unknown; the total is there only if no elapsed time is. CPU is per cent of all cores.
    """
    group = F.concat_ws(":", *[F.coalesce(c, F.lit("unknown")) for c in ("stage", "engine", "variant")], F.substr(F.sha2("identity", 256), F.lit(1), F.lit(16)))
    done, good = F.col("status") == "complete", F.col("result_status") == "complete"
    startup = (F.col("stage") == "vision_startup") & (F.col("result_status") == "not_applicable")
    ok = F.coalesce(done & good, F.lit(False))
    time, spent = T.measured(F.col("process_s")), T.measured(F.col("elapsed_s"))
    told = attempts.withColumn("group", group)
    main = told.groupBy("group").agg(
        F.count(F.lit(1)).alias("attempts"), _sum(ok).alias("complete"), _sum(done).alias("process_complete"), _sum(F.col("status") == "running").alias("pending"),
        _sum(~F.col("status").isin("complete", "running")).alias("process_failed"), _sum(done & F.col("result_status").isNotNull() & ~good & ~startup).alias("decode_failed"), _sum(done & startup).alias("not_applicable"),
        _sum(done & F.col("result_status").isNull()).alias("decode_unknown"), _sum(F.col("status").isNull()).alias("process_unknown"),
        F.median(F.when(ok, time)).alias("median_s"), F.avg(F.when(ok, time)).alias("mean_s"), F.count(spent).alias("measured"), F.coalesce(F.sum(spent), F.lit(0.0)).alias("known_s"),
    )
    # The samples are a branch of their own, so they multiply no attempt.
    s = told.select("group", "cores", F.explode("samples").alias("s"))
    cpu = F.when(F.col("cores") > 0, T.measured(F.col("s.cpu")) / F.col("cores"))
    load = s.groupBy("group").agg(F.avg(cpu).alias("cpu_percent"), F.avg(T.measured(F.col("s.gpu"))).alias("gpu_percent"))
    return main.join(load, "group", "left").withColumn("total_s", F.when(F.col("measured") == F.col("attempts"), F.col("known_s"))).withColumn("unknown_elapsed", F.col("attempts") - F.col("measured")).drop("measured")


def caption_quality(captions: DataFrame) -> DataFrame:
    """By model: statuses, median and nearest-rank 90th percentile of complete times, and lexical flags of complete captions
    (model, status, caption, elapsed_s): proxies, no scores."""
    done = F.col("status") == "complete"
    flag = lambda p: _sum(done & F.col("caption").rlike(p))
    time = F.when(done & (F.col("elapsed_s") > 0), F.col("elapsed_s"))
    leak = "|".join(f"({p})" for p in (T.EMAIL, T.URL.removeprefix("(?i)"), T.LONG_NUMBER))
    return captions.withColumn("__t", time).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), _sum(done).alias("complete"), _sum(F.col("status") == "incomplete").alias("incomplete"), _sum(F.col("status") == "filtered").alias("filtered"),
        F.median("__t").alias("median_s"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY __t)").alias("p90_s"),
        flag(T.UNCLEAR).alias("unclear"), flag(T.COMPLETION).alias("claims_done"), flag("(?i)" + leak).alias("identifiers"),
    )


def training_lines(examples: DataFrame) -> DataFrame:
    """(id, split, folder, line): reviewed examples as JSON lines of messages; test rows go to a folder of their own.

    examples: id, split, prompt, answer (JSON text), excluded, source_class. Excluded ones and those without an answer go.
    """
    user = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    model = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    line = F.to_json(F.struct("id", "split", "source_class", F.array(user, model).alias("messages")))
    ok = examples.where(F.col("answer").isNotNull() & ~F.coalesce("excluded", F.lit(False)))
    return ok.select("id", "split", F.when(F.col("split") == "test", "sealed").otherwise("export").alias("folder"), line.alias("line"))


def export_training(examples: DataFrame, path: str) -> DataFrame:
    """Writes training_lines() below path, by folder and split, and returns counts and order-free digests of what is there."""
    lines = training_lines(examples)
    lines.repartition("folder", "split", F.pmod(F.xxhash64("id"), F.lit(16))).select("folder", "split", F.col("line").alias("value")).write.partitionBy("folder", "split").text(path)
    back = examples.sparkSession.read.schema("value string, folder string, split string").text(path)
    piece = F.conv(F.substr(F.md5("value"), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return back.groupBy("folder", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum(piece).alias("digest"))
