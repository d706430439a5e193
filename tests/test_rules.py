"""Hand-computed cases of the rules: screen evidence, receipts, telemetry, reviews, splits and accounting."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import context as C
from spanloom.operators import fold, interval
from spanloom.operators import ledger as G
from spanloom.operators import quality as Q
from spanloom.operators import review as W
from spanloom.operators import trial as E
from spanloom.operators.asof import asof

S = 1_000_000
DAY = 86_400 * S


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_two_marks_count_each_second_once(spark):
    seg = spark.createDataFrame([(1, 0, 0, 3600 * S, "A", 3600 * S), (1, 0, 7200 * S, 7300 * S, "B", 50 * S)], "device long, day long, start_us long, end_us long, app string, sampled_us long")
    marks = spark.createDataFrame([(1, 1800 * S, 1, "x", None), (1, 1810 * S, 2, "x", "A"), (1, 1805 * S, 0, "other app", "B"), (1, 7250 * S, 3, "y", "B")], "device long, mark_us long, ord long, topic string, app string")
    got = {r.topic: r.us for r in C.screen_suggested(seg, marks, ["device", "day"]).collect()}
    assert 50 * S <= got["x"] <= 75 * S and "other app" not in got
    assert got["y"] == 30 * S  # 60 s around the mark, half of which was sampled


def test_labels_are_honest(spark):
    titles = ["YouTube Music", "My video", None, "", "Bank account", "inbox - Gmail"]
    df = spark.createDataFrame([(i, t, a, h) for i, (t, a, h) in enumerate(zip(titles, ["Editor", "Editor", "Google Chrome", "Editor", "Editor", None], [None, None, "a.org", None, None, None]))], "i long, t string, a string, h string")
    got = [r.l for r in df.select("i", T.broad_context(F.col("t"), F.col("a"), F.col("h")).alias("l")).orderBy("i").collect()]
    assert got == ["Music site (subject unknown)", "Video site (subject unknown)", "a.org (topic unknown)", "Editor (task unknown)", "Sensitive window (topic hidden)", "Messages (subject unknown)"]
    assert column(spark, ["com.apple.mobilenotes", "com.acme.big_tool", "plain", None, ""], T.app_name) == ["Notes", "Big Tool", "plain", "Unknown app", "Unknown app"]
    assert column(spark, ["Straße  ﬁn", "ÉCOLE\t1", None], T.normalize) == ["strasse fin", "école 1", None]
    assert column(spark, ["SQL tests and windows", "a video page"], lambda c: F.array_join(T.subject_tokens(c), ",")) == ["sql,test,window", ""]


def test_runs_must_add_up(spark):
    s = spark.createDataFrame(
        [(1, 1, 0, 10, "active", 10), (2, 1, 5, 20, "active", 15), (3, 1, 30, 30, "idle", 0), (4, 1, 40, 50, "napping", 10), (5, 1, 60, 70, "idle", 9), (6, 2, 0, 10, "idle", 10), (7, 1, DAY - 5, DAY + 5, "idle", 10), (8, 1, DAY, DAY + 9, "idle", 9)],
        "id long, device long, start_us long, end_us long, state string, sampled_us long",
    )
    support = spark.createDataFrame([(1, 0, 10), (2, 5, 20), (4, 40, 50), (5, 60, 70), (6, 0, 12), (7, DAY - 5, DAY + 5), (8, DAY, DAY + 9)], "id long, start_us long, end_us long")
    got = sorted((r.id, r.code) for r in G.validate_runs(s, support).collect())
    assert got == [(2, "overlap"), (3, "no_support"), (3, "not_positive"), (4, "unknown_state"), (5, "support_sum"), (6, "support_outside"), (6, "support_sum"), (8, "overlap")]


def test_receipts_have_an_age_by_kind(spark):
    r = spark.createDataFrame([("a", "fast", 1000 * S), ("a", "slow", 100 * S), ("b", "fast", 1125 * S), ("b", "slow", 1131 * S)], "source string, kind string, at_us long")
    limits = spark.createDataFrame([("fast", 60 * S), ("slow", 5400 * S), ("never", S)], "kind string, limit_us long")
    got = {(x.source, x.kind): (x.exists, x.fresh) for x in G.freshness(r, limits, 1100 * S, ["source"]).collect()}
    assert got == {("a", "fast"): (True, False), ("a", "slow"): (True, True), ("a", "never"): (False, False), ("b", "fast"): (True, True), ("b", "slow"): (True, False), ("b", "never"): (False, False)}


def test_source_quality_by_rank(spark):
    h = 3600 * S
    rows = [(0, 1, 100 * h, 0, 100 * h, 100 * h), (1, 0, 100 * h, None, None, 100 * h), (2, 0, 100 * h, 40 * 60, 90 * h, 100 * h), (3, 0, 100 * h, 60, 100 * h, 100 * h), (4, 0, 100 * h, 60, None, 100 * h), (5, 0, 100 * h, 60, 99 * h + 5 * 60 * S, 100 * h)]
    df = spark.createDataFrame(rows, "i long, reader_exit long, checked_us long, age_min long, ledger_us long, now_us long")
    got = [r.status for r in G.source_quality(df).orderBy("i").collect()]
    assert got == ["reader_failed", "source_timestamp_unavailable", "source_stale", "source_behind_retained_ledger", "no_retained_events", "source_current_relative_to_ledger"]


def test_telemetry_knows_what_it_does_not_know(spark):
    kind = "stage string, engine string, variant string, identity string, status string, result_status string, process_s double, elapsed_s double, cores long, samples array<struct<cpu:double,gpu:double>>"
    rows = [
        ("vision", "e", "v", "m", "complete", "complete", 4.0, 5.0, 8, [(400.0, None)]), ("vision", "e", "v", "m", "complete", "refused", 9.0, None, 8, []), ("vision", "e", "v", "m", "running", None, None, 1.0, 8, None),
        ("vision", "e", "v", "m", None, None, None, 1.0, None, [(90.0, 40.0)]), ("vision_startup", "e", "v", "m", "complete", "not_applicable", 1.0, 2.0, 8, []), ("vision", "e", "v", "n", "killed", None, None, 3.0, 8, []),
    ]
    got = {(r.group.split(":")[0], r.attempts): r for r in E.telemetry_groups(spark.createDataFrame(rows, kind)).collect()}
    main = got["vision", 4]
    assert (main.complete, main.process_complete, main.pending, main.decode_failed, main.process_unknown) == (1, 2, 1, 1, 1)
    assert main.cpu_percent == 50.0 and main.gpu_percent == 40.0 and main.total_s is None and main.known_s == 7.0 and main.unknown_elapsed == 1 and main.median_s == 4.0
    start = got["vision_startup", 1]
    assert (start.not_applicable, start.decode_failed, start.total_s) == (1, 0, 2.0) and got["vision", 1].process_failed == 1


def test_nomination_needs_both_rounds(spark):
    rows = [(1, 0, 100, 5, 0), (1, 1, 100, 5, 0), (2, 0, 80, 5, 0), (2, 1, 90, 5, 0), (3, 0, 85, 5, 0), (3, 1, 84, 6, 0), (4, 0, 10, 4, 0), (4, 1, 10, 5, 0), (5, 0, 10, 5, 1), (5, 1, 10, 5, 0)]
    df = spark.createDataFrame(rows, "variant long, round long, cost long, correct long, critical long")
    assert E.nominate_variant(df, 1).first().variant == 3
    assert E.nominate_variant(df.where("variant <> 3"), 1).first().asDict() == {"variant": 1, "total": 200}


def test_greedy_exclusion_in_order(spark):
    codes = [(1, 0, 0b0), (2, 0, 0b1111), (3, 0, 0b11111111), (4, 1, 0b1), (5, 1, 31 << 50), (6, 2, 31 << 50)]
    got = {r.id: r.kept for r in E.greedy_exclusion(spark.createDataFrame(codes, "id long, ord long, code long")).collect()}
    # 2 is near 1; so 3, which only 2 is near, stays; 4 is near 1; 6 repeats 5.
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_groups_stay_whole(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, "c", None), (5, None, None), (6, "d", "z"), (7, "c", "w")]
    got = E.whole_groups(spark.createDataFrame(rows, "id long, e string, i string"), ["e", "i"])
    assert {r.id: r.group for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 4}
    many = spark.range(1000).select("id", (F.col("id") % 300).alias("group"))
    held = E.hold_out(many, 0.2)
    n = held.where("held").count()
    assert 190 <= n <= 200 and held.groupBy("group").agg(F.count_distinct("held").alias("k")).where("k > 1").isEmpty()


def test_bootstrap_of_equal_clusters_is_sure(spark):
    same = spark.createDataFrame([(c, 3, 1) for c in range(6) for _ in range(4)], "c long, a long, b long")
    r = Q.cluster_bootstrap(same, "c", "a", "b", draws=50).first()
    assert (r.pairs, r.clusters, r.difference, r.low, r.high, r.wins) == (24, 6, 2.0, 2.0, 2.0, 24)
    one = Q.cluster_bootstrap(same.where("c = 0"), "c", "a", "b", draws=10).first()
    assert one.low is None and one.difference == 2.0


def test_summary_needs_every_block_once(spark):
    blocks = spark.createDataFrame([(1, "a", "h1"), (1, "b", "h2"), (2, "a", "new"), (3, "a", "h"), (4, "a", "h")], "k long, block string, input_sha string")
    cited = spark.createDataFrame([(1, "a", "h1"), (1, "b", "h2"), (2, "a", "old"), (3, "a", "h"), (3, "a", "h"), (4, "a", "h")], "k long, block string, input_sha string")
    themes = spark.createDataFrame([(1, ["a"]), (1, ["a", "b"]), (4, ["zz"]), (5, ["a"])], "k long, ids array<string>")
    assert {r.k: r.current for r in C.current_summaries(cited, themes, blocks, "k").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_asof_over_midnights(spark):
    rows = spark.createDataFrame([(1, 5, 10, "a"), (1, 6, 10, "b"), (1, 7, 3 * DAY + 5, "c"), (2, 8, 50, "d")], "device long, id long, start_us long, app string")
    points = spark.createDataFrame([(1, 9), (1, 10), (1, DAY + 1), (1, 3 * DAY + 4), (1, 3 * DAY + 5), (1, 9 * DAY), (2, 40), (3, 1)], "device long, at_us long")
    got = {(r.device, r.at_us): (r.match_us, r.app) for r in asof(points, rows, ["device"], "at_us", ["app"]).collect()}
    assert got == {(1, 9): (None, None), (1, 10): (10, "b"), (1, DAY + 1): (10, "b"), (1, 3 * DAY + 4): (10, "b"), (1, 3 * DAY + 5): (3 * DAY + 5, "c"), (1, 9 * DAY): (3 * DAY + 5, "c"), (2, 40): (None, None), (3, 1): (None, None)}


def test_merge_and_episodes_over_midnights(spark):
    spans = spark.createDataFrame([(1, 1, DAY - 5, DAY + 5), (1, 2, DAY + 5, 3 * DAY), (1, 3, 3 * DAY + 1, 3 * DAY + 2), (1, 4, 0, 3)], "device long, id long, start_us long, end_us long")
    assert sorted((r.start_us, r.end_us) for r in interval.merge_days(spans, ["device"]).collect()) == [(0, 3), (DAY - 5, 3 * DAY), (3 * DAY + 1, 3 * DAY + 2)]
    f = spark.createDataFrame([(1, 1, DAY - 100 * S, "a"), (1, 2, DAY - 10 * S, "a"), (1, 3, DAY + 50 * S, "a"), (1, 4, DAY + 100 * S, "b"), (1, 5, 2 * DAY - 1, "b"), (1, 6, 2 * DAY, "b")], "device long, id long, at_us long, c string")
    got = sorted((r.episode, r.frames) for r in fold.frame_episodes(f, ["device"], ["c"]).collect())
    assert got == [(1, 3), (4, 1), (5, 2)]


def test_health_in_chunks_equals_one_window(spark):
    rows = [(1, i, i * 30_000 * S // 7, "unattributed" if i % 9 else "active", True, True) for i in range(300)]
    df = spark.createDataFrame(rows, "device long, id long, start_us long, state string, screen_access boolean, ax_access boolean")
    got = {r.id: (r.windows, r.untitled, r.status) for r in W.identity_health(df, chunk=64).collect()}
    for i in range(300):
        last = rows[max(0, i - 59) : i + 1]
        n = sum(r[3] == "unattributed" for r in last)
        assert got[i] == (len(last), n, "needs_review" if len(last) >= 24 and n * 100 >= 80 * len(last) else "normal")


@pytest.mark.parametrize("bad, code", [({}, None), ({"observed_us": 11}, "state_sum"), ({"segments_overlapping": 1}, "segment_overlap"), ({"sessions_declared": 3}, "session_count"), ({"longest_us": 10**9}, "longest_context_bound")])
def test_accounting_drift_is_named(spark, bad, code):
    base = dict.fromkeys(["unattributed_us", "locked_us", "idle_us", "other_us", "segments_outside", "segments_overlapping", "segments_oversampled", "app_us", "sessions_outside", "sessions", "sessions_declared", "longest_app_us", "device_union_us", "union_us", "frames", "status_frames", "suggested_us", "distribution_sessions", "stretches", "sustained_us", "longest_us"], 0)
    base |= dict.fromkeys(["active_us", "observed_us", "segment_us", "topic_us", "focus_us", "identified_us", "distribution_us"], 10 * S) | {"unobserved_us": DAY - 10 * S, "span_us": DAY, "device": 1, "day": 0}
    if "observed_us" in bad:
        bad = {"observed_us": 11 * S, "segment_us": 11 * S, "unobserved_us": DAY - 11 * S}
    row = base | bad
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))
    assert [r.code for r in Q.check_accounting(df).collect()] == ([code] if code else [])
