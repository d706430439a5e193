from pyspark.sql import functions as F

from spanloom.functions.time import HOUR, SECOND
from spanloom.operators import activity as A
from spanloom.operators import allocate as L
from spanloom.operators import fold as D

S = SECOND


def runs(spark, rows):
    """rows: (start s, end s, state, app, win)"""
    data = [(i, 1, 0, s * S, e * S, st, a, w) for i, (s, e, st, a, w) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, device long, day long, start_us long, end_us long, state string, app string, win string")


def test_samples_to_segments(spark):
    data = [(1, 1, 0, 5 * S, "active", "a", "w"), (2, 1, int(5.1 * S), 5 * S, "active", "a", "w"), (3, 1, 120 * S, 5 * S, "idle", None, None), (4, 1, 200 * S, 0, "idle", None, None), (5, 1, 300 * S, 7 * HOUR, "idle", None, None)]
    samples = spark.createDataFrame(data, "id long, device long, start_us long, dur_us long, state string, app string, win string")
    got = A.segments(A.observed_runs(samples)).orderBy("start_us").collect()
    assert [(r.state, r.samples, r.sampled_us) for r in got] == [("active", 2, 10 * S), ("idle", 1, 5 * S)]


def test_midnight_cuts_and_later_samples_win(spark):
    day = 86_400 * S
    data = [(1, 1, day - 100 * S, 300 * S, "active", "a", "w"), (2, 1, day - 50 * S, 100 * S, "locked", None, None)]
    samples = spark.createDataFrame(data, "id long, device long, start_us long, dur_us long, state string, app string, win string")
    got = sorted((r.day, r.start_us - day, r.end_us - day, r.state) for r in A.observed_runs(samples).collect())
    assert got == [(0, -100 * S, -50 * S, "active"), (0, -50 * S, 0, "locked"), (1, 0, 50 * S, "locked")]


def test_state_totals_add_up(spark):
    r = A.state_totals(runs(spark, [(0, 100, "active", "a", "w"), (100, 130, "idle", None, None)])).first()
    assert (r.active_us, r.idle_us, r.observed_us, r.unobserved_us) == (100 * S, 30 * S, 130 * S, (86_400 - 130) * S)


def test_histogram_bounds_are_exclusive(spark):
    at, rows = 0, []
    for i, n in enumerate((119, 120, 300, 900, 1800)):
        rows.append((at, at + n, "active", "a", f"w{i}"))
        at += n
    sessions = A.behavior_sessions(A.segments(runs(spark, rows)))
    assert [(r.bucket, r.sessions) for r in A.duration_histogram(sessions).orderBy("bucket").collect()] == [(i, 1) for i in range(5)]
    m = A.behavior_measures(sessions).first()
    assert (m.switches, m.longest_us, m.sustained, m.brief) == (4, 1800 * S, 1, 1)


def test_blocks_end_at_barriers_and_at_900_s(spark):
    segs = A.segments(runs(spark, [(0, 300, "active", "a", "w"), (300, 600, "active", "a", "x"), (600, 605, "idle", None, None), (605, 2600, "active", "a", "w")]))
    got = [(r.start_us // S, r.end_us // S, round(r.us / S)) for r in A.focus_blocks(segs).orderBy("start_us").collect()]
    assert got == [(0, 600, 600), (605, 1505, 900), (1505, 2405, 900), (2405, 2600, 195)]


def test_block_begins_at_next_segment_after_900_s(spark):
    segs = A.segments(runs(spark, [(0, 890, "active", "a", "w"), (905, 1000, "active", "a", "w")]))
    assert [(r.start_us // S, r.end_us // S) for r in A.focus_blocks(segs).orderBy("start_us").collect()] == [(0, 890), (905, 1000)]


def test_state_precedence_of_bins(spark):
    got = A.activity_bins(runs(spark, [(0, 10, "idle", None, None), (10, 20, "locked", None, None), (300, 310, "unattributed", "b", None)])).orderBy("slot").collect()
    assert [r.state for r in got] == ["locked", "unattributed"]
    dense = A.dense_bins(A.activity_bins(runs(spark, [(0, 10, "idle", None, None)])), 300 * S)
    assert dense.count() == 288 and dense.where("observed").count() == 1 and dense.where("NOT observed AND idle_us IS NULL").count() == 287


def test_allocation_tiers(spark):
    r = runs(spark, [(0, 60, "unattributed", "a", None), (60, 120, "active", "a", "w"), (120, 130, "idle", None, None)])
    c = spark.createDataFrame([(1, 0, 0, 30 * S, "L"), (1, 0, 20 * S, 30 * S, "M")], "device long, day long, start_us long, end_us long, label string")
    h = spark.createDataFrame([(1, 0, 60 * S, 120 * S, 80 * S, "h1"), (1, 0, 60 * S, 120 * S, 100 * S, "h2")], "device long, day long, start_us long, end_us long, anchor_us long, label string")
    got = sorted((x.start_us // S, x.end_us // S, x.tier, x.label) for x in L.allocate(r, c, h, A.KEYS).collect())
    assert got == [
        (0, 20, "user_confirmed_label", "L"), (20, 30, "user_correction_conflict", None), (30, 60, "unclassified", None),
        (60, 90, "model_inference", "h1"), (90, 120, "model_inference", "h2"), (120, 130, "nonforeground", None),
    ]
    t = L.reconciled(L.allocate(r, c, h, A.KEYS), A.KEYS).first()
    assert t.observed_us == t.foreground_us + t.nonforeground_us and t.foreground_us == t.allocated_us + t.unknown_us


def test_clusters_do_not_chain(spark):
    # Each frame is near its neighbour, but only the first ones are near the first.
    rows = [(i, "x", i * 60 * S, "a", [0.06 * i], True) for i in range(8)]
    f = spark.createDataFrame(rows, "id long, display string, at_us long, app string, vector array<double>, eligible boolean")
    got = {r.id: r.first_id for r in D.similarity_clusters(f, ["display"]).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6}


def test_kept_frame_without_vector_matches_nothing(spark):
    f = spark.createDataFrame([(1, "x", 0, [0.0]), (2, "x", S, None), (3, "x", 2 * S, [0.0])], "id long, display string, at_us long, vector array<double>")
    assert sorted(r.id for r in D.feature_dedupe(f, ["display"]).collect()) == [1, 2, 3]


def test_label_propagation_abstains_on_conflict(spark):
    c = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 2, 3), (4, 3, 3)], "id long, at_us long, first_id long")
    labels = spark.createDataFrame([(1, "A"), (3, "A"), (4, "B")], "id long, label string")
    got = sorted((r.id, r.label, r.anchor) for r in D.label_propagation(c, labels).collect())
    assert got == [(1, "A", 1), (2, "A", 1)]


def test_cadence(spark):
    rows = [(1, 0, "c", 1, 0.0), (2, 10 * S, "c", 2, 9.0), (3, 30 * S, "c", 1, 9.0), (4, 31 * S, "c", 3, 0.5), (5, 55 * S, "c", 3, 5.0), (6, 56 * S, "d", 3, 5.0), (7, 200 * S, "d", 3, 5.0)]
    f = spark.createDataFrame([("x", *r) for r in rows], "device string, id long, at_us long, context string, digest long, level double")
    assert sorted(r.id for r in D.cadence_keep(f, ["device"]).collect()) == [1, 5, 6, 7]


def test_empty_runs(spark):
    none = runs(spark, [])
    segs = A.segments(none)
    for df in (segs, A.state_totals(none), A.behavior_sessions(segs), A.focus_blocks(segs), A.episodes(none), A.activity_bins(none)):
        assert df.count() == 0
    assert F is not None
