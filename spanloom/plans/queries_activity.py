"""Queries of the interval core and of activity by device and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.time import DAY, HOUR, MINUTE, SECOND
from spanloom.operators import activity as A
from spanloom.operators import allocate as L
from spanloom.operators import asof as J
from spanloom.operators import interval as I
from spanloom.operators import rollup as R
from spanloom.plans.book import Book
from spanloom.sources import adapters as V

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql


def _runs(spark, d):
    return A.observed_runs(V.samples(spark, d))


def _segs(spark, d):
    return A.segments(_runs(spark, d))


def _stretches(spark, d):
    return A.behavior_sessions(_segs(spark, d))


@query("WITH s AS (SELECT event_id AS id, user_id % 4 AS device, epoch_us(ts) AS start_us, CAST(round(value * 1e6) AS BIGINT) AS dur_us FROM events) SELECT * FROM s WHERE dur_us > 0 AND dur_us <= 30000000")
def valid_samples(spark, d):
    return A.valid(V.short_samples(spark, d), 30 * SECOND).select("id", "device", "start_us", "dur_us")


@query(f"WITH {V.SESSIONS} SELECT id, device, greatest(start_us, 1704153600000000) AS start_us, least(end_us, 1704758400000000) AS end_us FROM sessions WHERE start_us < 1704758400000000 AND end_us > 1704153600000000")
def clip_interval(spark, d):
    return I.clip(V.sessions(spark, d), V.EPOCH_2024 + DAY, V.EPOCH_2024 + 8 * DAY).select("id", "device", "start_us", "end_us")


@query(f"WITH {V.SAMPLES} SELECT id, device, start_us, dur_us FROM samples WHERE start_us >= 1704326400000000 - 21600000000 AND start_us < 1704412800000000")
def scan_events(spark, d):
    """A day's ledger rows with six hours of look-back; the bound is on the raw column, so the scan prunes."""
    e = V.table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-03 18:00:00' AND ts < timestamp_ntz'2024-01-05 00:00:00'")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("device"), V.micros("ts").alias("start_us"), F.round(F.col("value") * 20e6).cast("long").alias("dur_us"))


@query(f"WITH {V.RUNS} SELECT id, device, day, start_us, end_us FROM runs")
def trim_overlap(spark, d):
    return _runs(spark, d).select("id", "device", "day", "start_us", "end_us")


@query(f"WITH {V.RUNS} SELECT id, device, day, state, app, win, start_us, end_us, substr(sha256(concat_ws('|', device, start_us, end_us, state)), 1, 16) AS run_id FROM runs")
def observed_runs(spark, d):
    run_id = F.substr(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("device", "start_us", "end_us", "state")]), 256), F.lit(1), F.lit(16))
    return _runs(spark, d).select("id", "device", "day", "state", "app", "win", "start_us", "end_us", run_id.alias("run_id"))


@query(f"WITH {V.SEGMENTS} SELECT device, day, island, start_us, end_us, state, app, win, samples, sampled_us FROM segments")
def mac_segments(spark, d):
    return _segs(spark, d).select("device", "day", F.col("island").cast("long"), "start_us", "end_us", "state", "app", "win", "samples", "sampled_us")


@query(
    f"""WITH {V.SEGMENTS}, m AS (SELECT *, max(end_us) OVER (PARTITION BY device, day, island ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM numbered),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY device, day, island ORDER BY start_us) AS part FROM m)
    SELECT device, day, island, min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY device, day, island, part"""
)
def segment_support(spark, d):
    return A.support(_runs(spark, d)).select("device", "day", F.col("island").cast("long"), "start_us", "end_us")


@query(
    f"""WITH {V.RUNS}, b AS (SELECT device, day, day * 86400000000 AS low, (day + 1) * 86400000000 AS high FROM runs GROUP BY device, day),
    a AS (SELECT device, day, start_us, end_us FROM runs UNION ALL SELECT device, day, low, low FROM b UNION ALL SELECT device, day, high, high FROM b),
    m AS (SELECT *, max(end_us) OVER (PARTITION BY device, day ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a)
    SELECT device, day, reach AS start_us, start_us AS end_us FROM m WHERE start_us - reach >= 60000000"""
)
def coverage_gaps(spark, d):
    runs = _runs(spark, d)
    bounds = runs.select("device", "day").distinct().withColumns({"low_us": F.col("day") * DAY, "high_us": (F.col("day") + 1) * DAY})
    return I.gaps(runs, A.KEYS, 60 * SECOND, bounds)


UNION = """ m AS (SELECT device, start_us, end_us, max(end_us) OVER (PARTITION BY device ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sessions),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY start_us, end_us) AS island FROM m),
    merged AS (SELECT device, min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY device, island)"""


@query(f"WITH {V.SESSIONS}, {UNION} SELECT device, CAST(sum(end_us - start_us) AS BIGINT) AS union_us FROM merged GROUP BY device")
def interval_union(spark, d):
    # By day first: a device's years are then dealt to many tasks.
    return I.union_us(I.by_day(V.sessions(spark, d)), A.KEYS).groupBy("device").agg(F.sum("union_us").alias("union_us"))


@query(f"WITH {V.SESSIONS}, {UNION} SELECT * FROM merged")
def interval_merge(spark, d):
    return I.merge_days(V.sessions(spark, d), ["device"])


@query(
    f"""WITH {V.RUNS}, a AS (SELECT * FROM runs WHERE state = 'active'), s AS (SELECT user_id % 4 AS device, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 20e6) AS BIGINT) AS end_us FROM events WHERE event_type = 'signup' AND round(value * 20e6) > 0 AND round(value * 20e6) <= 21600000000)
    SELECT a.device, greatest(a.start_us, s.start_us) AS start_us, least(a.end_us, s.end_us) AS end_us FROM a JOIN s ON a.device = s.device AND a.start_us < s.end_us AND s.start_us < a.end_us"""
)
def interval_intersect(spark, d):
    idle = V.samples(spark, d).where("state = 'idle' AND dur_us > 0 AND dur_us <= 21600000000").withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    return I.intersect(_runs(spark, d).where("state = 'active'"), idle, ["device"])


SUBTRACT = """
    e AS (SELECT device, day, start_us AS t, 1 AS da, 0 AS db, id AS own FROM a UNION ALL SELECT device, day, end_us, -1, 0, NULL FROM a
      UNION ALL SELECT device, day, start_us, 0, 1, NULL FROM b UNION ALL SELECT device, day, end_us, 0, -1, NULL FROM b),
    g AS (SELECT device, day, t, sum(da) AS da, sum(db) AS db, max(own) AS own FROM e GROUP BY ALL),
    x AS (SELECT *, sum(da) OVER w AS in_a, sum(db) OVER w AS in_b, last_value(own IGNORE NULLS) OVER w AS id, lead(t) OVER (PARTITION BY device, day ORDER BY t) AS until
      FROM g WINDOW w AS (PARTITION BY device, day ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    p AS (SELECT device, day, id, t AS start_us, until AS end_us FROM x WHERE in_a > 0 AND in_b = 0 AND until > t),
    m2 AS (SELECT *, max(end_us) OVER (PARTITION BY device, day, id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach2 FROM p),
    i2 AS (SELECT *, sum(CASE WHEN reach2 IS NULL OR start_us > reach2 THEN 1 ELSE 0 END) OVER (PARTITION BY device, day, id ORDER BY start_us) AS part FROM m2),
    rest AS (SELECT device, day, id, min(start_us) AS start_us, max(end_us) AS end_us FROM i2 GROUP BY device, day, id, part)"""
A_LESS_B = f"""WITH {V.RUNS}, {V.SESSIONS.partition(', sessions AS')[1][2:]}{V.SESSIONS.partition(', sessions AS')[2]}{V.SESSION_DAYS}, a AS (SELECT * FROM runs WHERE state = 'active'), b AS (SELECT * FROM parts WHERE app = 'a2'),{SUBTRACT}"""


@query(A_LESS_B + " SELECT * FROM rest")
def interval_subtract(spark, d):
    b = I.by_day(V.sessions(spark, d)).where("app = 'a2'")
    return I.subtract(_runs(spark, d).where("state = 'active'"), b, A.KEYS)


@query(A_LESS_B + " SELECT device, day, count(*) AS parts, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM rest WHERE start_us < 1705968000000000 GROUP BY ALL")
def import_legacy_intervals(spark, d):
    """Window intervals less idle ones, up to the moment a newer collector takes over."""
    b = I.by_day(V.sessions(spark, d)).where("app = 'a2'")
    rest = I.subtract(_runs(spark, d).where("state = 'active'"), b, A.KEYS).where(F.col("start_us") < V.EPOCH_2024 + 22 * DAY)
    return rest.groupBy(*A.KEYS).agg(F.count(F.lit(1)).alias("parts"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"))


OVERLAP = f"""WITH {V.SESSIONS}{V.SESSION_DAYS}, t AS (SELECT device, day, start_us AS t FROM parts UNION SELECT device, day, end_us FROM parts),
    p AS (SELECT device, day, t AS start_us, lead(t) OVER (PARTITION BY device, day ORDER BY t) AS end_us FROM t),
    s AS (SELECT p.device, p.day, p.start_us, p.end_us, string_agg(DISTINCT x.app, '+' ORDER BY x.app) AS labels FROM p JOIN parts x ON p.device = x.device AND p.day = x.day AND x.start_us < p.end_us AND p.start_us < x.end_us GROUP BY ALL),
    n AS (SELECT *, sum(CASE WHEN lag_e = start_us AND lag_l = labels THEN 0 ELSE 1 END) OVER (PARTITION BY device, day ORDER BY start_us) AS island
      FROM (SELECT *, lag(end_us) OVER w AS lag_e, lag(labels) OVER w AS lag_l FROM s WINDOW w AS (PARTITION BY device, day ORDER BY start_us)))"""


@query(OVERLAP + " SELECT device, day, min(start_us) AS start_us, max(end_us) AS end_us, any_value(labels) AS labels FROM n GROUP BY device, day, island")
def overlap_partition(spark, d):
    return I.overlap_partition(I.by_day(V.sessions(spark, d)), A.KEYS, "app")


@query(f"WITH {V.RUNS} SELECT id, device, slot, greatest(start_us, slot * 300000000) AS start_us, least(end_us, (slot + 1) * 300000000) AS end_us FROM (SELECT *, unnest(range(start_us // 300000000, (end_us - 1) // 300000000 + 1)) AS slot FROM runs)")
def interval_bins(spark, d):
    return I.cut(_runs(spark, d), 5 * MINUTE).select("id", "device", "slot", "start_us", "end_us")


@query(f"WITH {V.RUNS} SELECT DISTINCT device, unnest(range(start_us // 1800000000, (end_us - 1) // 1800000000 + 1)) AS half_hour FROM runs WHERE state = 'active'")
def half_hour_bins(spark, d):
    return I.half_hours(_runs(spark, d).where("state = 'active'"), ["device"])


@query(f"WITH {V.RUNS}{V.TOTALS} SELECT * FROM totals")
def state_totals(spark, d):
    return A.state_totals(_runs(spark, d))


@query(
    f"""WITH {V.RUNS}, apps AS (SELECT device, day, app, CAST(sum(end_us - start_us) AS BIGINT) AS us, CAST(sum(CASE WHEN state = 'unattributed' THEN end_us - start_us ELSE 0 END) AS BIGINT) AS app_only_us
    FROM runs WHERE state IN ('active', 'unattributed') GROUP BY device, day, app) SELECT * FROM apps"""
)
def app_totals(spark, d):
    return A.app_totals(_runs(spark, d))


@query(f"WITH {V.SESSIONS}{V.SESSION_DAYS} SELECT * FROM summary")
def phone_summary(spark, d):
    return A.session_summary(V.sessions(spark, d))


@query(
    f"""WITH {V.RUNS}, c AS (SELECT device, state, slot, greatest(start_us, slot * 3600000000) AS s, least(end_us, (slot + 1) * 3600000000) AS e FROM (SELECT *, unnest(range(start_us // 3600000000, (end_us - 1) // 3600000000 + 1)) AS slot FROM runs))
    SELECT device, slot % 24 AS hour, state, CAST(sum(e - s) AS BIGINT) AS us FROM c GROUP BY ALL"""
)
def hour_of_day(spark, d):
    return A.hour_profile(_runs(spark, d))


BINS = f"""WITH {V.RUNS}, c AS (SELECT device, state, app, slot, greatest(start_us, slot * 300000000) AS s, least(end_us, (slot + 1) * 300000000) AS e FROM (SELECT *, unnest(range(start_us // 300000000, (end_us - 1) // 300000000 + 1)) AS slot FROM runs)),
    ap AS (SELECT device, slot, app, sum(e - s) AS us, min(s) AS seen FROM c WHERE app IS NOT NULL GROUP BY ALL),
    tp AS (SELECT device, slot, app AS top_app FROM ap QUALIFY row_number() OVER (PARTITION BY device, slot ORDER BY us DESC, seen) = 1),
    bins AS (SELECT device, slot, {', '.join(f"CAST(sum(CASE WHEN state = '{s}' THEN e - s ELSE 0 END) AS BIGINT) AS {s}_us" for s in A.PRECEDENCE)} FROM c GROUP BY ALL),
    full_bins AS (SELECT device, slot, active_us, unattributed_us, locked_us, idle_us, CASE WHEN active_us > 0 THEN 'active' WHEN unattributed_us > 0 THEN 'unattributed' WHEN locked_us > 0 THEN 'locked' WHEN idle_us > 0 THEN 'idle' ELSE 'unknown' END AS state, top_app
      FROM bins LEFT JOIN tp USING (device, slot))"""


@query(BINS + " SELECT * FROM full_bins")
def activity_bins(spark, d):
    return A.activity_bins(_runs(spark, d))


@query(BINS + ", sp AS (SELECT device, unnest(range(day * 288, (day + 1) * 288)) AS slot FROM (SELECT DISTINCT device, slot // 288 AS day FROM bins)) SELECT sp.device, sp.slot, active_us, state, state IS NOT NULL AS observed FROM sp LEFT JOIN full_bins USING (device, slot)")
def dense_activity_bins(spark, d):
    return A.dense_bins(A.activity_bins(_runs(spark, d)), 5 * MINUTE).select("device", "slot", "active_us", "state", "observed")


@query(f"WITH {V.STRETCHES} SELECT * FROM stretches")
def behavior_sessions(spark, d):
    return _stretches(spark, d)


@query(f"WITH {V.STRETCHES} SELECT * FROM measures")
def behavior_measures(spark, d):
    return A.behavior_measures(_stretches(spark, d))


@query(
    f"""WITH {V.STRETCHES}, c AS (SELECT device, CASE WHEN us < 120000000 THEN 0 WHEN us < 300000000 THEN 1 WHEN us < 900000000 THEN 2 WHEN us < 1800000000 THEN 3 ELSE 4 END AS bucket, count(*) AS sessions, sum(us) AS us FROM stretches GROUP BY ALL),
    sp AS (SELECT device, b AS bucket FROM (SELECT DISTINCT device FROM stretches), (SELECT unnest(range(5)) AS b))
    SELECT device, bucket, coalesce(sessions, 0) AS sessions, CAST(coalesce(us, 0) AS BIGINT) AS us FROM sp LEFT JOIN c USING (device, bucket)"""
)
def duration_histogram(spark, d):
    return A.duration_histogram(_stretches(spark, d))


@query(f"WITH {V.STRETCHES} SELECT device, count(*) AS days, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(switches) AS BIGINT) AS switches, CAST(sum(us) AS BIGINT) AS us, max(longest_us) AS longest_us, CAST(sum(switches) * 1000 // count(*) AS BIGINT) AS switches_per_day_x1000 FROM measures GROUP BY device")
def behavior_period(spark, d):
    return A.behavior_period(_stretches(spark, d))


APPS = f"""WITH {V.SEGMENTS}, f AS (SELECT *, CASE WHEN lag(app) OVER w IS NOT DISTINCT FROM app AND start_us - lag(end_us) OVER w BETWEEN 0 AND 20000000 THEN 0 ELSE 1 END AS new,
      CASE WHEN lag(win) OVER w IS NOT DISTINCT FROM win THEN 0 ELSE 1 END AS moved FROM segments WHERE state = 'active' WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY device, day ORDER BY start_us) AS stretch FROM f),
    app_stretches AS (SELECT device, day, any_value(app) AS app, min(start_us) AS start_us, max(end_us) AS end_us, CAST(sum(CASE WHEN new = 1 THEN 0 ELSE moved END) AS BIGINT) AS window_changes FROM n GROUP BY device, day, stretch)"""


@query(APPS + " SELECT * FROM app_stretches")
def app_stretches(spark, d):
    return A.app_stretches(_segs(spark, d)).select("device", "day", "app", "start_us", "end_us", F.col("window_changes").cast("long"))


@query(APPS + " SELECT device, day, app, end_us - start_us AS wall_us, window_changes, start_us FROM app_stretches QUALIFY row_number() OVER (PARTITION BY device, day ORDER BY end_us - start_us DESC, start_us) = 1")
def app_stretch(spark, d):
    return A.longest_app_stretch(_segs(spark, d)).withColumn("window_changes", F.col("window_changes").cast("long"))


FOLD = """WITH RECURSIVE {base}, f AS (
    SELECT device, day, part, r, start_us AS pos, end_us AS seg_end, start_us AS block_start, least(end_us, start_us + 900000000) AS block_end, 1 AS cut, 1 AS block, {carry}
    FROM numbered_parts WHERE r = 1
    UNION ALL
    SELECT device, day, part, r, pos, seg_end, CASE WHEN fresh THEN pos ELSE block_start END, least(seg_end, CASE WHEN fresh THEN pos ELSE block_start END + 900000000), cut + 1, block + CASE WHEN fresh THEN 1 ELSE 0 END, {carry}
    FROM (
      SELECT f.device, f.day, f.part, f.block_start, f.block, f.cut,
        CASE WHEN f.block_end < f.seg_end THEN f.r ELSE n.r END AS r, CASE WHEN f.block_end < f.seg_end THEN f.block_end ELSE n.start_us END AS pos,
        CASE WHEN f.block_end < f.seg_end THEN f.seg_end ELSE n.end_us END AS seg_end,
        (CASE WHEN f.block_end < f.seg_end THEN f.block_end ELSE n.start_us END) - f.block_start >= 900000000 AS fresh, {pick}
      FROM f LEFT JOIN numbered_parts n ON n.device = f.device AND n.day = f.day AND n.part = f.part AND n.r = f.r + 1
      WHERE f.block_end < f.seg_end OR n.r IS NOT NULL))"""

BLOCK_PARTS = f"""{V.SEGMENTS}, ok AS (SELECT *, state = 'active' AND sampled_us > 0 AS ok FROM segments),
    nw AS (SELECT *, CASE WHEN coalesce(NOT lag(ok) OVER w, true) OR NOT coalesce(lag(app) OVER w IS NOT DISTINCT FROM app AND start_us - lag(end_us) OVER w BETWEEN 0 AND 20000000, false) THEN 1 ELSE 0 END AS fresh_part FROM ok WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
    pt AS (SELECT *, sum(fresh_part) OVER (PARTITION BY device, day ORDER BY start_us) AS part FROM nw),
    numbered_parts AS (SELECT *, row_number() OVER (PARTITION BY device, day, part ORDER BY start_us) AS r FROM pt WHERE ok)"""


@query(
    FOLD.format(base=BLOCK_PARTS, carry="app", pick="f.app AS app")
    + """, g AS (SELECT device, day, part, block, any_value(app) AS app, min(block_start) AS start_us, max(block_end) AS end_us FROM f GROUP BY device, day, part, block)
    SELECT device, day, row_number() OVER (PARTITION BY device, day ORDER BY start_us) AS block, start_us, end_us, app FROM g"""
)
def focus_blocks(spark, d):
    return A.focus_blocks(_segs(spark, d)).select("device", "day", "block", "start_us", "end_us", "app")


EPISODE_PARTS = f"""{V.SEGMENTS}, numbered_parts AS (SELECT device, day, island AS part, state, app, win, start_us, end_us, row_number() OVER (PARTITION BY device, day, island ORDER BY start_us) AS r FROM numbered)"""
EPISODES = FOLD.format(base=EPISODE_PARTS, carry="state, app, win", pick="f.state AS state, f.app AS app, f.win AS win") + """, episodes AS (
    SELECT device, day, min(block_start) AS start_us, max(block_end) AS end_us, CAST(sum(block_end - pos) AS BIGINT) AS us, any_value(state) AS state, any_value(app) AS app, any_value(win) AS win FROM f GROUP BY device, day, part, block)"""


@query(EPISODES + " SELECT * FROM episodes")
def episodes(spark, d):
    return A.episodes(_runs(spark, d))


@query(f"WITH {V.SEGMENTS} SELECT device, app, win, CAST(sum(sampled_us) AS BIGINT) AS us, row_number() OVER (PARTITION BY device ORDER BY sum(sampled_us) DESC, min(start_us)) AS rank FROM segments WHERE state = 'active' GROUP BY device, app, win QUALIFY rank <= 3")
def window_totals(spark, d):
    return A.window_totals(_segs(spark, d), 3)


@query(
    f"""WITH {V.SEGMENTS}, tb AS (SELECT event_id AS id, user_id % 4 AS device, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) AS start_us, 'h' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7)::VARCHAR AS site, event_type = 'view' AS focused FROM events WHERE event_type IN ('view', 'error')),
    l AS (SELECT *, lead(start_us) OVER (PARTITION BY device, day ORDER BY start_us, id) AS end_us FROM tb)
    SELECT l.device, site, CAST(sum(least(l.end_us, s.end_us) - greatest(l.start_us, s.start_us)) AS BIGINT) AS us FROM l JOIN segments s ON s.device = l.device AND s.day = l.day AND s.state = 'active' AND s.app = 'app1' AND s.start_us < l.end_us AND l.start_us < s.end_us
    WHERE focused AND l.end_us > l.start_us GROUP BY l.device, site"""
)
def browser_overlap(spark, d):
    return A.browser_overlap(V.tabs(spark, d), _segs(spark, d))


ASOF = f"WITH {V.RUNS}, {V.FRAMES}, j AS (SELECT f.id, f.device, f.at_us, s.start_us AS match_us, s.app, s.win, s.end_us FROM frames f ASOF LEFT JOIN runs s ON f.device = s.device AND f.at_us >= s.start_us)"


def _asof(spark, d):
    return J.asof(V.frames(spark, d).select("id", "device", "at_us", "text"), _runs(spark, d), ["device"], "at_us", ["app", "win", "end_us"])


@query(ASOF + " SELECT id, device, match_us, CASE WHEN at_us - match_us <= 15000000 THEN app END AS app_15s, CASE WHEN at_us - match_us <= 300000000 THEN app END AS app_300s FROM j")
def asof_window(spark, d):
    f = _asof(spark, d)
    return f.select("id", "device", "match_us", J.within("at_us", 15 * SECOND, "app").alias("app_15s"), J.within("at_us", 300 * SECOND, "app").alias("app_300s"))


@query(ASOF + " SELECT id, device, match_us AS run_start_us, at_us < end_us AS inside FROM j WHERE match_us IS NOT NULL")
def episode_of_instant(spark, d):
    return _asof(spark, d).where("match_us IS NOT NULL").select("id", "device", F.col("match_us").alias("run_start_us"), (F.col("at_us") < F.col("end_us")).alias("inside"))


@query(f"WITH {V.RUNS}, {V.FRAMES} SELECT f.id, f.device, f.at_us FROM frames f WHERE EXISTS (SELECT 1 FROM runs r WHERE r.device = f.device AND r.state = 'unattributed' AND f.at_us >= r.start_us AND f.at_us < r.end_us)")
def point_in_interval(spark, d):
    return I.point_join(V.frames(spark, d).select("id", "device", "at_us"), _runs(spark, d).where("state = 'unattributed'").select("device", "start_us", "end_us"), ["device"], how="left_semi")


FACTS = f"""{V.STRETCHES}{V.TOTALS}, {V.SESSIONS.partition(', sessions AS')[1][2:]}{V.SESSIONS.partition(', sessions AS')[2]}{V.SESSION_DAYS},
    fg AS (SELECT device, day, count(DISTINCT app) AS apps, CAST(sum(end_us - start_us) AS BIGINT) AS foreground_us FROM runs WHERE state IN ('active', 'unattributed') GROUP BY ALL),
    su AS (SELECT device, day, any_value(device_union_us) AS session_union_us FROM summary GROUP BY ALL),
    facts AS (SELECT device, day, active_us, unattributed_us, locked_us, idle_us, observed_us, unobserved_us, apps, foreground_us, session_union_us, sessions AS stretches, switches, longest_us,
      CASE WHEN observed_us >= 43200000000 THEN 'full' WHEN observed_us >= 14400000000 THEN 'partial' ELSE 'sparse' END AS coverage
      FROM totals LEFT JOIN fg USING (device, day) LEFT JOIN su USING (device, day) LEFT JOIN measures USING (device, day))"""


def _facts(spark, d):
    runs = _runs(spark, d)
    return R.day_facts(A.state_totals(runs), A.app_totals(runs), A.session_summary(V.sessions(spark, d)), A.behavior_measures(A.behavior_sessions(A.segments(runs))))


@query(f"WITH {FACTS} SELECT * FROM facts")
def day_facts(spark, d):
    return _facts(spark, d)


@query(
    f"""WITH {FACTS}, dt AS (SELECT *, year(DATE '1970-01-01' + CAST(day AS INTEGER)) AS year, month(DATE '1970-01-01' + CAST(day AS INTEGER)) AS month FROM facts)
    SELECT device, year, month, count(*) AS days, CAST(sum(observed_us) AS BIGINT) AS observed_us, CAST(sum(active_us) AS BIGINT) AS active_us, count(*) FILTER (coverage = 'full') AS full_days, max(longest_us) AS longest_us FROM dt GROUP BY GROUPING SETS ((device, year, month), (device, year))"""
)
def period_rollup(spark, d):
    return R.period_rollup(_facts(spark, d))


@query(
    f"""WITH {FACTS}, dt AS (SELECT *, year(DATE '1970-01-01' + CAST(day AS INTEGER)) AS year, month(DATE '1970-01-01' + CAST(day AS INTEGER)) AS month FROM totals)
    SELECT device, year, month, count(*) AS days, CAST(sum(observed_us) AS BIGINT) AS observed_us, CAST(sum(active_us) AS BIGINT) AS active_us FROM dt GROUP BY GROUPING SETS ((device, year, month), (device, year))"""
)
def incremental_periods(spark, d):
    """Months and years after two refreshes: one without the rows that come late, one with them."""
    from spanloom.sources.periods import refresh
    from spanloom.sources.scratch import scratch

    base = scratch(spark)
    rows = _runs(spark, d).select("id", "device", "day", "state", "start_us", "end_us")

    def total(days, keys):
        return days.groupBy("device", *keys).agg(F.count(F.lit(1)).alias("days"), F.sum("observed_us").alias("observed_us"), F.sum("active_us").alias("active_us"))

    for part in (rows.where("day % 7 <> 3 OR id % 5 <> 0"), rows):
        refresh(part, base, A.state_totals, total)
    months, years = (spark.read.parquet(f"{base}/{x}") for x in ("months", "years"))
    both = months.unionByName(years, allowMissingColumns=True)
    return both.select("device", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "days", "observed_us", "active_us")


@query(f"WITH {FACTS}, sp AS (SELECT device, unnest(range(m - 6, m + 1)) AS day FROM (SELECT device, max(day) AS m FROM facts GROUP BY device)) SELECT sp.device, sp.day, observed_us, observed_us IS NULL AS missing FROM sp LEFT JOIN facts USING (device, day)")
def densify_week(spark, d):
    return R.densify_week(_facts(spark, d)).select("device", "day", "observed_us", "missing")


@query(f"WITH {FACTS}, sp AS (SELECT device, unnest(range(a, b + 1)) AS day FROM (SELECT device, min(day) AS a, max(day) AS b FROM facts GROUP BY device)) SELECT sp.device, sp.day, active_us, active_us IS NULL AS missing FROM sp LEFT JOIN (SELECT * FROM facts WHERE day % 5 <> 0 OR device = 1) USING (device, day)")
def densify_period(spark, d):
    f = _facts(spark, d).select("device", "day", "active_us")
    # Some days are taken out, so that missing ones show.
    kept = f.where("day % 5 <> 0 OR device = 1")
    edge = f.groupBy("device").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = edge.select("device", F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(kept, ["device", "day"], "left").withColumn("missing", F.col("active_us").isNull())


@query(f"WITH {FACTS} SELECT device, day, observed_us, coverage FROM facts")
def history_days(spark, d):
    return _facts(spark, d).select("device", "day", "observed_us", "coverage")


@query(f"WITH {FACTS} SELECT device, day, CAST(CASE WHEN foreground_us > 0 THEN active_us * 1000000 // foreground_us END AS BIGINT) AS identified_ppm, CAST(observed_us * 1000000 // 86400000000 AS BIGINT) AS observed_ppm FROM facts")
def day_metrics(spark, d):
    return _facts(spark, d).select("device", "day", F.expr("CASE WHEN foreground_us > 0 THEN active_us * 1000000 div foreground_us END").alias("identified_ppm"), F.expr(f"observed_us * 1000000 div {DAY}").alias("observed_ppm"))


@query(f"WITH {FACTS} SELECT device, day, observed_us, source FROM (SELECT device, day, observed_us, 'recent' AS source, 0 AS p FROM facts WHERE day > (SELECT max(day) - 8 FROM facts) UNION ALL SELECT device, day, observed_us, 'stored', 1 FROM facts) QUALIFY row_number() OVER (PARTITION BY device, day ORDER BY p) = 1")
def history_overlay(spark, d):
    f = _facts(spark, d).select("device", "day", "observed_us")
    # One row joins every row: the last day.
    recent = f.join(F.broadcast(f.agg(F.max("day").alias("m")))).where("day > m - 8").drop("m").withColumn("source", F.lit("recent"))
    return R.history_overlay(recent, f.withColumn("source", F.lit("stored")), A.KEYS)


@query(
    f"""WITH {V.STRETCHES}, t AS (SELECT device, day, context AS label, CAST(sum(us) AS BIGINT) AS us FROM stretches GROUP BY ALL UNION ALL SELECT device, day, NULL, CAST(sum(sampled_us) AS BIGINT) FROM segments WHERE state = 'unattributed' GROUP BY ALL),
    k AS (SELECT device, label FROM (SELECT device, label, sum(us) AS su FROM t WHERE label IS NOT NULL GROUP BY device, label) QUALIFY row_number() OVER (PARTITION BY device ORDER BY su DESC, label) <= 2)
    SELECT t.device, t.day, CASE WHEN t.label IS NULL THEN 'Unknown' WHEN k.label IS NOT NULL THEN t.label ELSE 'Other' END AS label, CAST(sum(us) AS BIGINT) AS us FROM t LEFT JOIN k USING (device, label) GROUP BY ALL"""
)
def evolution_matrix(spark, d):
    segs = _segs(spark, d)
    t = A.behavior_sessions(segs).groupBy("device", "day", F.col("context").alias("label")).agg(F.sum("us").alias("us"))
    u = segs.where("state = 'unattributed'").groupBy("device", "day").agg(F.sum("sampled_us").alias("us")).withColumn("label", F.lit(None).cast("string"))
    return R.evolution(t.unionByName(u), 2)


@query(
    f"""WITH {V.RUNS}, c AS (SELECT device, day, state, slot % 24 AS hour, least(end_us, (slot + 1) * 3600000000) - greatest(start_us, slot * 3600000000) AS us FROM (SELECT *, unnest(range(start_us // 3600000000, (end_us - 1) // 3600000000 + 1)) AS slot FROM runs)),
    h AS (SELECT device, day, hour, sum(us) / 1e6 AS s FROM c WHERE state = 'active' GROUP BY ALL), sp AS (SELECT device, day, unnest(range(24)) AS hour FROM (SELECT DISTINCT device, day FROM runs))
    SELECT device, day, hour, CAST(CASE WHEN s IS NULL THEN NULL WHEN s <= 0 THEN 0 WHEN s < 900 THEN 1 WHEN s < 1800 THEN 2 WHEN s < 2700 THEN 3 ELSE 4 END AS BIGINT) AS level, s IS NULL AS missing FROM sp LEFT JOIN h USING (device, day, hour)"""
)
def weekly_heatmap(spark, d):
    slots = I.cut(_runs(spark, d), HOUR)
    hours = slots.groupBy("device", "day", (F.col("slot") % 24).alias("hour"), "state").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    return R.week_heatmap(hours)


REVIEW = f"""WITH {V.RUNS}, rs AS (SELECT device, slot, CAST(sum(least(end_us, (slot + 1) * 900000000) - greatest(start_us, slot * 900000000)) AS BIGINT) AS unknown_us
    FROM (SELECT *, unnest(range(start_us // 900000000, (end_us - 1) // 900000000 + 1)) AS slot FROM runs WHERE state = 'unattributed') GROUP BY device, slot)"""


def _review(spark, d):
    u = I.cut(_runs(spark, d).where("state = 'unattributed'"), 15 * MINUTE)
    return u.groupBy("device", "slot").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("unknown_us")).where(F.col("unknown_us") >= 120 * SECOND)


@query(REVIEW + " SELECT * FROM rs WHERE unknown_us >= 120000000")
def review_slots(spark, d):
    return _review(spark, d)


@query(REVIEW + " SELECT device, slot, unknown_us, row_number() OVER (PARTITION BY device ORDER BY unknown_us DESC, slot) AS rank FROM rs WHERE unknown_us >= 120000000 QUALIFY rank <= 12")
def longest_gaps_to_review(spark, d):
    from spanloom.operators.rank import top_k

    return top_k(_review(spark, d), ["device"], "unknown_us", "slot", 12)


def _evidence(spark, d):
    """Corrections and hypotheses on the sample clock: purchases of some users confirm, errors of some suggest."""
    e = V.samples(spark, d)
    day = F.floor(F.col("start_us") / DAY)
    c = e.where("k % 10 = 3").select("device", day.alias("day"), "start_us", (F.col("start_us") + 600 * SECOND).alias("end_us"), F.concat(F.lit("c"), (F.col("k") % 4).cast("string")).alias("label"))
    h = e.where("k % 10 IN (1, 2)").select("device", day.alias("day"), (F.col("start_us") - 30 * SECOND).alias("start_us"), (F.col("start_us") + 30 * SECOND).alias("end_us"), F.col("start_us").alias("anchor_us"), F.concat(F.lit("h"), (F.col("k") % 3).cast("string")).alias("label"))
    return c, h


EVIDENCE = f"""WITH {V.RUNS}, c AS (SELECT device, start_us // 86400000000 AS day, start_us, start_us + 600000000 AS end_us, 'c' || (k % 4)::VARCHAR AS label FROM samples WHERE k % 10 = 3),
    h AS (SELECT device, start_us // 86400000000 AS day, start_us - 30000000 AS start_us, start_us + 30000000 AS end_us, start_us AS anchor_us, 'h' || (k % 3)::VARCHAR AS label FROM samples WHERE k % 10 IN (1, 2)),
    hs AS (SELECT DISTINCT r.device, r.day, r.id, anchor_us, r.start_us AS a_s, r.end_us AS a_e FROM runs r JOIN h ON h.device = r.device AND h.day = r.day AND h.start_us < r.end_us AND r.start_us < h.end_us),
    tt AS (SELECT r.device, r.day, r.id, unnest([c.start_us, c.end_us]) AS t, r.start_us AS a_s, r.end_us AS a_e FROM runs r JOIN c ON c.device = r.device AND c.day = r.day AND c.start_us < r.end_us AND r.start_us < c.end_us
      UNION ALL SELECT r.device, r.day, r.id, unnest([h.start_us, h.end_us]), r.start_us, r.end_us FROM runs r JOIN h ON h.device = r.device AND h.day = r.day AND h.start_us < r.end_us AND r.start_us < h.end_us
      UNION ALL SELECT device, day, id, (prior + anchor_us) // 2, a_s, a_e FROM (SELECT *, lag(anchor_us) OVER (PARTITION BY device, day, id ORDER BY anchor_us) AS prior FROM hs) WHERE prior IS NOT NULL),
    pp AS (SELECT device, day, id, t FROM tt WHERE t > a_s AND t < a_e UNION SELECT device, day, id, unnest([start_us, end_us]) FROM runs),
    pc AS (SELECT device, day, id, t AS start_us, lead(t) OVER (PARTITION BY device, day, id ORDER BY t) AS end_us FROM pp),
    pieces AS (SELECT pc.*, (pc.start_us + pc.end_us) // 2 AS mid, r.state FROM pc JOIN runs r USING (device, day, id) WHERE pc.end_us IS NOT NULL),
    cc AS (SELECT p.device, p.day, p.id, p.start_us, count(DISTINCT label) AS c_n, min(label) AS c_l FROM pieces p JOIN c ON c.device = p.device AND c.day = p.day AND c.start_us < p.end_us AND p.start_us < c.end_us WHERE p.state = 'unattributed' GROUP BY ALL),
    hd AS (SELECT p.device, p.day, p.id, p.start_us, abs(anchor_us - mid) AS dist, count(DISTINCT label) AS h_n, min(label) AS h_l FROM pieces p JOIN h ON h.device = p.device AND h.day = p.day AND h.start_us < p.end_us AND p.start_us < h.end_us WHERE p.state IN ('active', 'unattributed') GROUP BY ALL),
    hh AS (SELECT * FROM hd QUALIFY row_number() OVER (PARTITION BY device, day, id, start_us ORDER BY dist) = 1),
    allocated AS (SELECT p.device, p.day, p.id, p.start_us, p.end_us, p.state, CASE WHEN state NOT IN ('active', 'unattributed') THEN 'nonforeground' WHEN c_n = 1 THEN 'user_confirmed_label' WHEN c_n > 1 THEN 'user_correction_conflict' WHEN h_n = 1 THEN 'model_inference' WHEN h_n > 1 THEN 'model_conflict' ELSE 'unclassified' END AS tier, c_l, h_l
      FROM pieces p LEFT JOIN cc USING (device, day, id, start_us) LEFT JOIN hh USING (device, day, id, start_us))"""


@query(EVIDENCE + " SELECT device, day, id, start_us, end_us FROM pieces")
def label_scope_split(spark, d):
    c, h = _evidence(spark, d)
    return L.scope_pieces(_runs(spark, d), c, h, A.KEYS).select("device", "day", "id", "start_us", "end_us")


@query(EVIDENCE + " SELECT device, day, id, start_us, end_us, state, tier, CASE WHEN tier = 'user_confirmed_label' THEN c_l WHEN tier = 'model_inference' THEN h_l END AS label FROM allocated")
def episode_allocation(spark, d):
    return L.allocate(_runs(spark, d), *_evidence(spark, d), A.KEYS)


@query(
    EVIDENCE
    + """ SELECT device, day, CAST(sum(end_us - start_us) AS BIGINT) AS observed_us, CAST(sum(CASE WHEN tier <> 'nonforeground' THEN end_us - start_us ELSE 0 END) AS BIGINT) AS foreground_us, CAST(sum(CASE WHEN tier = 'nonforeground' THEN end_us - start_us ELSE 0 END) AS BIGINT) AS nonforeground_us,
    CAST(sum(CASE WHEN tier IN ('user_confirmed_label', 'model_inference') THEN end_us - start_us ELSE 0 END) AS BIGINT) AS allocated_us, CAST(sum(CASE WHEN tier NOT IN ('nonforeground', 'user_confirmed_label', 'model_inference') THEN end_us - start_us ELSE 0 END) AS BIGINT) AS unknown_us FROM allocated GROUP BY device, day"""
)
def allocation_totals(spark, d):
    return L.reconciled(L.allocate(_runs(spark, d), *_evidence(spark, d), A.KEYS), A.KEYS)


@query(EVIDENCE + " SELECT c.device, c.day, label, CAST(sum(least(r.end_us, c.end_us) - greatest(r.start_us, c.start_us)) AS BIGINT) AS us FROM c JOIN runs r ON c.device = r.device AND c.day = r.day AND r.state = 'unattributed' AND c.start_us < r.end_us AND r.start_us < c.end_us GROUP BY ALL")
def user_label_totals(spark, d):
    return L.user_label_totals(_evidence(spark, d)[0], _runs(spark, d), A.KEYS)
