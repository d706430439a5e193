"""Hand-computed cases of the core rules, and refreshes that leave alone what did not change."""

import os

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.time import DAY, HOUR, MINUTE, SECOND
from spanloom.operators import activity as A
from spanloom.operators import context as C
from spanloom.operators import review as W
from spanloom.sources import ingest
from spanloom.sources.periods import refresh

RUN = "id long, device long, day long, state string, app string, win string, start_us long, end_us long"


def runs(spark, rows):
    """(start s, end s, state, app, win) of one device and day."""
    return spark.createDataFrame([(i, 1, 0, state, app, win, s * SECOND, e * SECOND) for i, (s, e, state, app, win) in enumerate(rows)], RUN)


def test_work_paths(spark):
    work = ["src/a.py", "a", "./a.py", "src//b.py", "x/statement.txt", "src/m.pyc", "A.LOGS"]
    other = [
        None, "", "/abs/a.py", "../a.py", ".git/x", "src/.hidden", "web/out/index.html", "target/a", "logs/a.txt", "state/run.sqlite3-wal",
        "a.db", "x.sqlite3-wal", "a.swp", "A.LOG", "notes~", "node_modules/x.js", "data/a.csv", "site-packages/p.py",
    ]
    df = spark.createDataFrame([(p,) for p in work + other], "path string")
    assert [r[0] for r in df.select(T.is_work_path(F.col("path"))).collect()] == [True] * len(work) + [False] * len(other)


def test_bounds_by_source(spark):
    rows = [("mac_window_sample", 30), ("mac_window_sample", 31), ("mac_idle", 0), ("mac_idle_legacy", 6 * 3600), ("mac_idle_legacy", 6 * 3600 + 1), ("browser_tab", 5), (None, 5)]
    df = spark.createDataFrame([(s, n * SECOND) for s, n in rows], "source string, dur_us long")
    assert [(r.source, r.dur_us // SECOND) for r in A.valid_sources(df).orderBy("source").collect()] == [("mac_idle_legacy", 21600), ("mac_window_sample", 30)]


def test_tab_time_is_scaled_by_what_was_sampled(spark):
    # A merged segment of 100 s holds 60 s of samples; the tab is in front for its second half, so 30 s count.
    segs = spark.createDataFrame([(1, 0, "active", "Chrome", 0, 100 * SECOND, 60 * SECOND), (1, 0, "idle", None, 100 * SECOND, 200 * SECOND, 100 * SECOND), (1, 0, "unattributed", "chrome beta", 200 * SECOND, 210 * SECOND, 10 * SECOND)], "device long, day long, state string, app string, start_us long, end_us long, sampled_us long")
    tabs = spark.createDataFrame([(1, 1, 0, 50 * SECOND, "a.org", True), (2, 1, 0, 150 * SECOND, "b.org", True), (3, 1, 0, 205 * SECOND, "b.org", False), (4, 1, 0, 206 * SECOND, None, True)], "id long, device long, day long, start_us long, site string, focused boolean")
    assert {r.site: r.us for r in A.browser_shares(tabs, segs).collect()} == {"a.org": 30 * SECOND, "b.org": 5 * SECOND}
    last = tabs.where("id = 1")
    assert {r.site: r.us for r in A.browser_shares(last, segs).collect()} == {"a.org": 40 * SECOND}


def test_a_new_host_or_evidence_is_a_new_segment(spark):
    df = runs(spark, [(0, 5, "active", "c", "w"), (5, 10, "active", "c", "w"), (10, 15, "active", "c", "w"), (15, 20, "active", "c", "w")])
    df = df.withColumns({"host": F.when(F.col("id") < 2, "a.org").when(F.col("id") == 2, "b.org"), "evidence": F.lit("exact")})
    same = ("state", "evidence", "app", "win", "host")
    assert [(r.host, r.samples) for r in A.segments(df, same=same).orderBy("start_us").collect()] == [("a.org", 2), ("b.org", 1), (None, 1)]
    assert A.segments(df).count() == 1


def test_what_a_focus_block_holds(spark):
    df = runs(spark, [(0, 600, "active", "a", "one"), (600, 1200, "active", "a", "my bank account"), (1200, 1300, "active", "a", "credit card form"), (1300, 1400, "active", "a", None)])
    got = {(r.start_us // SECOND, r.title): (r.us / SECOND, r.rank, r.windows) for r in A.block_windows(A.segments(df)).collect()}
    assert got == {(0, "one"): (600, 1, 2), (0, "[sensitive window]"): (300, 2, 2), (900, "[sensitive window]"): (400, 1, 1)}


def episodes(spark, rows, marks=(), barriers=()):
    df = runs(spark, rows).withColumn("barrier", F.col("id").isin(*barriers) if barriers else F.lit(False))
    at = spark.createDataFrame([(1, m * SECOND) for m in marks], "device long, at_us long")
    return [(r.start_us // SECOND, r.end_us // SECOND, r.us // SECOND) for r in A.bounded_episodes(df, at).orderBy("start_us").collect()]


def test_boundaries_and_barriers_end_episodes(spark):
    rows = [(0, 100, "active", "a", "w"), (101, 200, "active", "a", "w")]
    assert episodes(spark, rows) == [(0, 200, 199)]
    assert episodes(spark, rows, marks=[40]) == [(0, 40, 40), (40, 200, 159)]
    # Between two runs, and at the very start of one.
    assert episodes(spark, rows, marks=[100]) == episodes(spark, rows, marks=[101]) == [(0, 100, 100), (101, 200, 99)]
    assert episodes(spark, rows, marks=[250]) == [(0, 200, 199)]
    assert episodes(spark, rows + [(200, 210, "active", "a", "w")], barriers=[1]) == [(0, 100, 100), (101, 200, 99), (200, 210, 10)]
    assert episodes(spark, [(0, 2000, "active", "a", "w")], marks=[950]) == [(0, 900, 900), (900, 950, 50), (950, 1850, 900), (1850, 2000, 150)]


def test_episode_ids_name_their_content(spark):
    marks = spark.createDataFrame([], "device long, at_us long")
    ids = lambda rows: [r.episode_id for r in A.bounded_episodes(runs(spark, rows).withColumn("barrier", F.lit(False)), marks).collect()]
    one, again, other = ids([(0, 9, "active", "a", "w")]), ids([(0, 9, "active", "a", "w")]), ids([(0, 9, "active", "a", "v")])
    assert one == again != other and len(one[0]) == len("episode-") + 64
    assert ids([(0, 9, "active", "a", "w"), (10, 20, "active", "a", "w")]) != ids([(0, 20, "active", "a", "w")])


def test_scores_of_bins(spark):
    df = runs(spark, [(0, 100, "active", "a", "w"), (100, 250, "unattributed", "a", None), (300, 310, "idle", None, None), (600, 700, "active", "a", "v")])
    df = df.withColumn("topic", F.when(F.col("id") == 0, "mail").when(F.col("id") == 3, "code"))
    phone = spark.createDataFrame([(1, 0, 60 * SECOND, "x"), (1, 30 * SECOND, 90 * SECOND, "y"), (1, 40 * SECOND, 90 * SECOND, "y")], "device long, start_us long, end_us long, app string")
    screens = spark.createDataFrame([(1, 110 * SECOND, "plan"), (1, 120 * SECOND, "plan"), (1, 130 * SECOND, "mail"), (1, 650 * SECOND, "code")], "device long, at_us long, topic string")
    got = {r.slot: r for r in A.activity_score(df, phone, screens, now_us=600 * SECOND).collect()}
    assert len(got) == 288 and [got[i].state for i in (0, 1, 2, 3)] == ["active", "idle", "future", "future"]
    assert (got[0].topic, got[0].screen_topic, got[0].phone_us, got[0].phone_app, got[0].unattributed_us) == ("mail", "plan", 90 * SECOND, "y", 150 * SECOND)
    assert got[2].screen_topic is None and got[2].topic == "code" and (got[1].phone_us, got[1].phone_app, got[3].active_us) == (0, None, 0)


def test_the_last_line_of_a_log_counts(spark):
    logs = ["a: load time = 5 ms\na: prompt eval time = 20.5 ms / 7 tokens\na: eval time = 10 ms / 2 runs\nencode_image took 33 ms\na: eval time = 500 ms / 50 runs", "prompt eval time = 4 ms", "", None]
    got = T.engine_report(spark.createDataFrame(list(enumerate(logs)), "id int, log string"), "log").orderBy("id").drop("id", "log").collect()
    assert got[0].asDict() == {"load_s": 0.005, "prompt_s": 0.0205, "prompt_tokens": 7, "generation_s": 0.5, "generated_tokens": 50, "encode_s": 0.033, "tokens_per_s": 100.0}
    assert got[1].prompt_s == 0.004 and got[1].generation_s is None and all(v is None for g in got[2:] for v in g)


def test_frames_tried_twice_or_skipped_are_left(spark):
    source = spark.createDataFrame([(i, "incomplete" if i < 6 else "complete") for i in range(9)], "path long, status string")
    tried = spark.createDataFrame([(1, "complete", 1), (2, "sensitive_skipped", 1), (3, "incomplete", 1), (4, "incomplete", 2), (7, "failed", 1), (8, "failed", 3)], "path long, status string, attempts long")
    readable = spark.range(9).where("id <> 5").withColumnRenamed("id", "path")
    assert sorted((r.path, r.fallback, r.attempts) for r in W.fallback_candidates(source, tried, readable, "incomplete").collect()) == [(0, None, 0), (3, "incomplete", 1)]
    assert sorted(r.path for r in W.fallback_candidates(source, tried, readable, "complete").collect()) == [6, 7]


def test_descriptions_are_set_by_path_model_and_prompt(spark):
    kind = "path string, model string, prompt int, status string, attempts long, elapsed_s double, at_us long, n long"
    old = spark.createDataFrame([("p", "m", 1, "failed", 1, 2.0, 10, 1), ("p", "m", 2, "complete", 1, 3.0, 11, 1)], kind)
    new = spark.createDataFrame([("p", "m", 1, "complete", 2, 4.0, 20, 2), ("p", "x", 1, "failed", 1, 5.0, 21, 1)], kind)
    got = sorted((r.model, r.prompt, r.status, r.attempts) for r in ingest.upsert_descriptions(old, new).collect())
    assert got == [("m", 1, "complete", 2), ("m", 2, "complete", 1), ("x", 1, "failed", 1)]


def test_descriptions_of_one_time_and_number_do_not_depend_on_the_order_of_rows(spark):
    kind = "path string, model string, prompt int, status string, attempts long, elapsed_s double, at_us long, n long"
    rows = [("p", "m", 1, "complete", 5, 24.0, 20, 5), ("p", "m", 1, "filtered", 5, 24.0, 20, 5), ("p", "m", 1, "incomplete", 5, 17.0, 20, 5), ("p", "m", 1, "failed", 9, 99.0, None, 9)]
    none = spark.createDataFrame([], kind)
    for given in (rows, rows[::-1], rows[1:] + rows[:1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(given, kind).coalesce(1)
        got = [r for pair in ((df, none), (none, df)) for r in ingest.upsert_descriptions(*pair).collect()]
        assert [(r.status, r.attempts, r.elapsed_s, r.at_us, r.n) for r in got] == [("filtered", 5, 24.0, 20, 5)] * 2


def files(base, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(os.path.join(base, name)) for f in fs if f.endswith(".parquet")}


def test_one_late_row_rewrites_one_day_month_and_year(spark, tmp_path):
    base, first = str(tmp_path / "p"), 19_700  # December 2023 on
    rows = [(i, 1 + i % 2, first + i % 70, 10 * i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, device long, day long, us long")
    facts = lambda r: r.groupBy("device", "day").agg(F.sum("us").alias("us"))
    total = lambda days, keys: days.groupBy("device", *keys).agg(F.sum("us").alias("us"), F.count(F.lit(1)).alias("days"))
    assert refresh(df, base, facts, total)["days"] == 70
    before = {k: files(base, k) for k in ("days", "months", "years")}
    assert refresh(df, base, facts, total) == {"days": 0, "months": 0, "years": 0} and files(base, "days") == before["days"]
    late = df.unionByName(spark.createDataFrame([(999, 1, first + 40, 7)], df.schema))
    assert refresh(late, base, facts, total) == {"days": 1, "months": 1, "years": 1}
    after = {k: files(base, k) for k in before}
    for k in before:
        kept = [f for f in before[k] if after[k].get(f) == before[k][f]]
        folders = {os.path.dirname(f) for f in before[k]}
        assert len({os.path.dirname(f) for f in kept}) == len(folders) - 1, k
    whole = str(tmp_path / "whole")
    refresh(late, whole, facts, total)
    for k in before:
        sort = lambda b: sorted(tuple(r) for r in spark.read.parquet(f"{b}/{k}").select("device", "year", "us").collect())  # noqa: E731,B023
        assert sort(base) == sort(whole)
    # A day whose rows are gone is touched as well.
    assert refresh(late.where(F.col("day") != first + 3), base, facts, total)["days"] == 1


@pytest.mark.parametrize("hours", [23, 25])
def test_bins_of_a_day_of_its_own_length(spark, hours):
    low = {23: 1_772_949_600, 25: 1_793_509_200}[hours] * SECOND  # 2026-03-08 and 2026-11-01 in Chicago
    day = {23: 20_520, 25: 20_758}[hours]
    df = spark.createDataFrame([(1, 1, day, "active", "a", "w", low + HOUR, low + HOUR + MINUTE, "t")], RUN + ", topic string")
    none = spark.createDataFrame([], "device long, start_us long, end_us long, app string")
    screens = spark.createDataFrame([], "device long, at_us long, topic string")
    got = A.activity_score(df, none, screens, now_us=low + 100 * DAY, zone="America/Chicago").collect()
    assert len(got) == hours * 12 and sum(r.active_us for r in got) == MINUTE


def test_a_label_counts_only_if_its_scope_covers_the_slot(spark):
    m = MINUTE
    slots = spark.createDataFrame([(1, 0, 5 * m), (1, 1, 4 * m), (1, 2, 3 * m)], "device long, slot long, unknown_us long")
    unknown = spark.createDataFrame([(1, 0, 5 * m), (1, 16 * m, 20 * m), (1, 30 * m, 33 * m)], "device long, start_us long, end_us long")
    scopes = spark.createDataFrame([(1, 0, "plan", 0, 15 * m), (1, 1, "mail", 15 * m, 18 * m)], "device long, slot long, label string, start_us long, end_us long")
    outcomes = spark.createDataFrame([(1, 0), (1, 0)], "device long, slot long")
    topics = spark.createDataFrame([(1, m, "b"), (1, 2 * m, "a"), (1, 3 * m, "a"), (1, 31 * m, "z"), (1, 32 * m, "y")], "device long, at_us long, topic string")
    got = {r.slot: r for r in W.review_view(slots, unknown, scopes, outcomes, topics, 15 * m).collect()}
    assert len(got) == 3 and (got[0].confirmed_label, got[0].unconfirmed_us, got[0].suggested_label, got[0].outcome_marked) == ("plan", 0, "a", True)
    assert (got[1].confirmed_label, got[1].scope_label, got[1].confirmed_us, got[1].unconfirmed_us, got[1].outcome_marked) == (None, "mail", 2 * m, 2 * m, False)
    assert (got[2].confirmed_us, got[2].unconfirmed_us, got[2].suggested_label) == (0, 3 * m, "z")


def test_switches_an_hour_are_made_of_sums(spark):
    df = runs(spark, [(0, 900, "active", "a", "one"), (900, 1800, "active", "a", "two"), (1800, 1810, "idle", None, None), (1810, 3610, "active", "b", "two")])
    got = A.switch_rates(A.segments(df)).first()
    assert (got.window_switches, got.app_switches, got.us, got.switches_per_hour_x1000) == (2, 1, HOUR, 2000)


def test_a_laid_out_ledger_is_read_by_day_and_without_exchange(spark, tmp_path):
    from spanloom.sources import book_of_days as B

    rows = [(i, i % 3, i * HOUR, 600 * SECOND, "active" if i % 2 else "idle", "a", "w") for i in range(24 * 5)]
    df = spark.createDataFrame(rows, "id long, device long, start_us long, dur_us long, state string, app string, win string").withColumn("source", F.col("state"))
    B.store(df, "ledger_test", str(tmp_path / "ledger"), 4)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    got = A.observed_runs(B.read_days(spark, "ledger_test", 2 * DAY, 3 * DAY))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and size
    scan = spark.table("ledger_test").where(F.col("on_day").between(1, 2)).inputFiles()
    assert scan and all("on_day=" in f for f in scan)
    assert "PartitionFilters: [isnotnull(on_day" in plan
    want = A.observed_runs(df.where((F.col("start_us") >= 2 * DAY - 6 * HOUR) & (F.col("start_us") < 3 * DAY)))
    pick = lambda x: sorted(tuple(r) for r in x.select("id", "start_us", "end_us").collect())
    assert pick(got) == pick(want) and len(pick(got)) == 30
    spark.sql("DROP TABLE ledger_test")


def test_merged_day_sketches_are_near_the_whole(spark):
    from spanloom.operators import rollup as R

    df = spark.range(40_000).select((F.col("id") % 3).alias("device"), (F.col("id") % 50).alias("day"), (F.col("id") * 7919 % 9000).alias("path"), (F.col("id") % 1001).alias("us"))
    got = R.period_sketches(R.day_sketches(df, ["device", "day"], "path", "us"), ["device"]).collect()
    for g in got:
        exact = df.where(F.col("device") == g.device).agg(F.count_distinct("path").alias("n")).first().n
        assert abs(g.distinct_items - exact) <= exact * 0.05 and abs(g.median - 500) <= 25 and abs(g.p90 - 900) <= 25
    assert len(got) == 3


def test_topics_need_a_word_and_a_subject(spark):
    rows = [("Unclear", "", "", True), ("Budget report", "budget", "the budget reports of May", True), ("Budget report", "budget", "a bud", False), ("Garden", "budget", "the budget", False), ("Budget", "bud", "budget", False), (None, "budget", "budget", False), ("Budget", None, None, False)]
    df = spark.createDataFrame(rows, "topic string, word string, source string, ok boolean")
    assert [r[0] for r in df.select(T.supported_topic(F.col("topic"), F.col("word"), F.col("source"))).collect()] == [r[3] for r in rows]


def test_what_is_private_is_flagged_and_refused(spark):
    rules = [("acme", "word", "[org]"), ("C-12.3", "literal", "[id]")]
    texts = ["Acme and acmes, C-12.3 not C-1293", "see /Users/kim/a", "in JSON \\/Users\\/kim\\/a", "mail kim@acme.org", "mail a@example.com or noreply@github.com", "a@example.com b@other.io", "fine", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r[0] for r in df.orderBy("id").select(T.publishable(F.col("text"), rules)).collect()]
    assert got == ["[org] and acmes, [id] not C-1293", None, None, "mail kim@[org].org", texts[4], None, "fine", None]
    found = {(r.id, r.kind): (r.lines, r.first_line) for r in T.privacy_scan(df, "id", "text", [(a, b) for a, b, _ in rules]).collect()}
    assert found == {(0, "identifier"): (1, 1), (1, "home_path"): (1, 1), (2, "home_path"): (1, 1), (3, "identifier"): (1, 1), (3, "contact"): (1, 1), (5, "contact"): (1, 1)}
    with pytest.raises(ValueError):
        T.identifier_pattern("ab", "word")


def test_topic_stretches(spark):
    """One topic over two apps; a sensitive title has none; a return from idle and a gap are no switches."""
    rows = [
        (0, 600, "active", "editor", "plan.md"), (600, 1300, "active", "browser", "Budget sheet"), (1300, 1400, "active", "editor", "other.md"),
        (1400, 1410, "idle", None, None), (1410, 1500, "active", "editor", "plan.md"),
        (1505, 1600, "active", "editor", "plan.md"), (1600, 1601, "active", "editor", "password list"), (1601, 1700, "active", None, None),
    ]
    segs = runs(spark, rows).withColumn("sampled_us", F.col("end_us") - F.col("start_us"))
    tags = [("editor", "plan.md", "Budget planning", "model_inference"), ("browser", "Budget sheet", "Budget planning", "model_inference"), ("editor", "other.md", "Taxes", "rejected"), ("editor", "password list", "Password change", "model_inference")]
    told = C.topic_stretches(segs, spark.createDataFrame(tags, "app string, win string, topic string, status string"), ["device", "day"])
    got = sorted(((r.start_us // SECOND, r.end_us // SECOND, r.label, r.status, r.apps, r.switched, r.window_switches) for r in told.collect()))
    assert got == [
        (0, 1300, "Budget planning", "specific_model", ["editor", "browser"], False, 1),
        (1300, 1400, "other.md", "observed_window", ["editor"], True, 1),
        (1410, 1500, "Budget planning", "specific_model", ["editor"], False, 0),
        (1505, 1600, "Budget planning", "specific_model", ["editor"], False, 0),
        (1600, 1601, "Sensitive window (topic hidden)", "observed_window", ["editor"], True, 1),
        (1601, 1700, "Unclear", "observed_window", [], True, 1),
    ]
    m = C.stretch_measures(told, ["device"]).first()
    us = 1300 + 100 + 90 + 95 + 1 + 99
    assert (m.sessions, m.context_switches, m.window_switches, m.us, m.longest_us, m.sustained_us, m.brief) == (6, 3, 4, us * SECOND, 1300 * SECOND, 1300 * SECOND, 5)
    assert (m.median_us, m.switches_per_hour_x1000) == (97 * SECOND, 3 * 3600 * 1000 // us)
    assert C.stretch_measures(told.limit(0), ["device"]).collect() == []
