"""Days, hours and periods where devices are: 23, 24 or 25 hours long, in each device's own zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.time import DAY, SECOND, day_number, day_start
from spanloom.operators import activity as A
from spanloom.operators import interval as I
from spanloom.operators import rank as K
from spanloom.operators import rollup as R
from spanloom.plans.book import Book
from spanloom.sources import adapters as V

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql
#: The zone of what belongs to no device, and by how much orders are moved so that they fall among the samples.
HOME, MOVED = "America/Chicago", 11_688 * DAY


def _own():
    return F.col("zone")


def _runs(spark, d):
    return A.observed_runs(V.zoned(V.samples(spark, d), "start_us"), zone=_own())


def _sessions(spark, d):
    return V.zoned(V.sessions(spark, d), "start_us", "end_us")


def _calendar(spark, d):
    return V.calendar(spark, d).withColumns({c: F.col(c) + MOVED for c in ("start_us", "end_us")})


@query(f"WITH {V.LOCAL_RUNS}, {V.LOCAL_SESSIONS} SELECT id, device, day, start_us, end_us, low_us, high_us FROM parts")
def local_days(spark, d):
    day = F.col("day")
    parts = I.by_day(_sessions(spark, d), _own())
    return parts.select("id", "device", "day", "start_us", "end_us", day_start(day, _own()).alias("low_us"), day_start(day + 1, _own()).alias("high_us"))


@query(
    f"""WITH {V.LOCAL_RUNS}, b AS (SELECT device, day, min(low_us) AS low, max(high_us) AS high FROM runs GROUP BY device, day),
    a AS (SELECT device, day, start_us, end_us FROM runs UNION ALL SELECT device, day, low, low FROM b UNION ALL SELECT device, day, high, high FROM b),
    m AS (SELECT *, max(end_us) OVER (PARTITION BY device, day ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a)
    SELECT device, day, reach AS start_us, start_us AS end_us FROM m WHERE start_us - reach >= 60000000"""
)
def local_gaps(spark, d):
    runs = _runs(spark, d)
    return I.gaps(runs, A.KEYS, 60 * SECOND, I.day_spans(runs, A.KEYS, _own()))


@query(f"WITH {V.LOCAL_RUNS}{V.LOCAL_TOTALS} SELECT * FROM totals")
def local_state_totals(spark, d):
    return A.state_totals(_runs(spark, d), _own())


QUARTERS = """(SELECT *, unnest(range(start_us // 900000000, (end_us - 1) // 900000000 + 1)) AS slot FROM {rows})"""
LOCAL_HOUR = f"{V.local_sql('greatest(start_us, slot * 900000000)')} // 3600000000 % 24"
LENGTH = "least(end_us, (slot + 1) * 900000000) - greatest(start_us, slot * 900000000)"
HOURS = f"""h AS (SELECT device, day, {LOCAL_HOUR} AS hour, state, {LENGTH} AS us FROM {QUARTERS.format(rows='runs')})"""


@query(
    f"""WITH {V.LOCAL_RUNS}, {V.LOCAL_SESSIONS}, {HOURS},
    sd AS (SELECT device, start_us, end_us, zone FROM sessions), mm AS (SELECT *, max(end_us) OVER (PARTITION BY device ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sd),
    ii AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY start_us, end_us) AS island FROM mm),
    un AS (SELECT device, any_value(zone) AS zone, min(start_us) AS start_us, max(end_us) AS end_us FROM ii GROUP BY device, island),
    ph AS (SELECT device, hour, CAST(sum(us) AS BIGINT) AS phone_us FROM (SELECT device, {LOCAL_HOUR} AS hour, {LENGTH} AS us FROM {QUARTERS.format(rows='un')}) GROUP BY ALL),
    co AS (SELECT device, hour, {', '.join(f"CAST(sum(CASE WHEN state = '{s}' THEN us ELSE 0 END) AS BIGINT) AS {s}_us" for s in A.PRECEDENCE)} FROM h GROUP BY ALL),
    sp AS (SELECT device, unnest(range(24)) AS hour FROM (SELECT device FROM runs UNION SELECT device FROM sessions))
    SELECT device, hour, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*[f'{s}_us' for s in A.PRECEDENCE], 'phone_us'))} FROM sp LEFT JOIN co USING (device, hour) LEFT JOIN ph USING (device, hour)"""
)
def local_hours_of_day(spark, d):
    return A.hours_of_day(_runs(spark, d), _sessions(spark, d), _own())


@query(f"WITH {V.LOCAL_RUNS}, {V.LOCAL_SESSIONS} SELECT * FROM summary")
def local_phone_summary(spark, d):
    return A.session_summary(_sessions(spark, d), _own())


CALENDAR = f"""{V.CALENDAR}, ct AS (SELECT id, start_us + {MOVED} AS start_us, end_us + {MOVED} AS end_us, '{HOME}' AS zone FROM calendar WHERE NOT all_day AND end_us > start_us AND end_us - start_us < 86400000000),
    {V.days_sql('ct', 'cd')}, cm AS (SELECT *, max(end_us) OVER (PARTITION BY day ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cd),
    meetings AS (SELECT day, CAST(sum(greatest(0, end_us - greatest(start_us, coalesce(reach, start_us)))) AS BIGINT) AS union_us, count(DISTINCT id) AS events FROM cm GROUP BY day)"""


@query(f"WITH {CALENDAR} SELECT * FROM meetings")
def local_calendar(spark, d):
    return R.calendar_summary(_calendar(spark, d), HOME)


FACTS = f"""{V.LOCAL_STRETCHES}{V.LOCAL_TOTALS}, {V.LOCAL_SESSIONS}, {CALENDAR}, {V.FRAMES}, {V.COMMITS},
    fg AS (SELECT device, day, count(DISTINCT app) AS apps, CAST(sum(end_us - start_us) AS BIGINT) AS foreground_us FROM runs WHERE state IN ('active', 'unattributed') GROUP BY ALL),
    su AS (SELECT device, day, any_value(device_union_us) AS session_union_us FROM summary GROUP BY ALL),
    ff AS (SELECT device, day, count(*) AS frames, count(toxic) AS suggested FROM (SELECT device, toxic, {V.local_sql('at_us + ' + V.SHIFT_SQL, V.ZONE_SQL)} // 86400000000 AS day FROM frames LEFT JOIN labels ON doc_id = id) GROUP BY ALL),
    wa AS (SELECT {V.local_sql(f'at_us + {MOVED}', f"'{HOME}'")} // 86400000000 AS day, count(*) AS commits, count(DISTINCT repo) AS repositories FROM commits GROUP BY 1),
    facts AS (SELECT device, day, active_us, unattributed_us, locked_us, idle_us, observed_us, unobserved_us, apps, foreground_us, session_union_us, measures.sessions AS stretches, switches, longest_us, frames, suggested, events, meetings.union_us AS meeting_us, commits, repositories,
      CASE WHEN observed_us >= 43200000000 THEN 'full' WHEN observed_us >= 14400000000 THEN 'partial' ELSE 'sparse' END AS coverage
      FROM totals LEFT JOIN fg USING (device, day) LEFT JOIN su USING (device, day) LEFT JOIN measures USING (device, day) LEFT JOIN ff USING (device, day) LEFT JOIN meetings USING (day) LEFT JOIN wa USING (day))"""


def _facts(spark, d):
    runs = _runs(spark, d)
    frames = V.zoned(V.frames(spark, d), "at_us").join(V.tags(spark, d), "id", "left").groupBy("device", day_number(F.col("at_us"), _own()).alias("day")).agg(F.count(F.lit(1)).alias("frames"), F.count("topic").alias("suggested"))
    meetings = R.calendar_summary(_calendar(spark, d), HOME).select("day", "events", F.col("union_us").alias("meeting_us"))
    work = V.commits(spark, d).groupBy(day_number(F.col("at_us") + MOVED, HOME).alias("day")).agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("repo").alias("repositories"))
    return R.day_facts(A.state_totals(runs, _own()), A.app_totals(runs), A.session_summary(_sessions(spark, d), _own()), A.behavior_measures(A.behavior_sessions(A.segments(runs))), frames, meetings, work)


@query(f"WITH {FACTS} SELECT * FROM facts")
def local_day_facts(spark, d):
    """All parts of a day in one row: computer, phone, behaviour, frames, suggestions, calendar and artifacts."""
    return _facts(spark, d)


@query(
    f"""WITH {FACTS}, dt AS (SELECT *, year(DATE '1970-01-01' + CAST(day AS INTEGER)) AS year, month(DATE '1970-01-01' + CAST(day AS INTEGER)) AS month FROM facts)
    SELECT device, year, month, count(*) AS days, CAST(sum(observed_us) AS BIGINT) AS observed_us, CAST(sum(active_us) AS BIGINT) AS active_us, count(*) FILTER (coverage = 'full') AS full_days, max(longest_us) AS longest_us FROM dt GROUP BY GROUPING SETS ((device, year, month), (device, year))"""
)
def local_period_rollup(spark, d):
    return R.period_rollup(_facts(spark, d))


@query(
    f"""WITH {V.LOCAL_RUNS}, ap AS (SELECT device, day, app, sum(end_us - start_us) AS us, year(DATE '1970-01-01' + CAST(day AS INTEGER)) AS year, month(DATE '1970-01-01' + CAST(day AS INTEGER)) AS month FROM runs WHERE state IN ('active', 'unattributed') GROUP BY device, day, app)
    SELECT device, year, month, app, CAST(sum(us) AS BIGINT) AS us, count(DISTINCT day) AS days FROM ap GROUP BY GROUPING SETS ((device, year, month, app), (device, year, app))"""
)
def local_period_apps(spark, d):
    return R.period_totals(A.app_totals(_runs(spark, d)), "app", "us")


@query(f"WITH {V.ANNOTATIONS} SELECT {V.local_sql('at_us', f'{chr(39)}{HOME}{chr(39)}')} // 86400000000 AS day, count(DISTINCT path) AS captioned FROM annotations WHERE status = 'complete' GROUP BY ALL")
def local_captioned(spark, d):
    return V.annotations(spark, d).where("status = 'complete'").groupBy(day_number(F.col("at_us"), HOME).alias("day")).agg(F.count_distinct("path").alias("captioned"))


@query(f"WITH {V.LOCAL_RUNS} SELECT device, min(day) AS day FROM runs GROUP BY device")
def local_earliest_day(spark, d):
    first = V.zoned(V.samples(spark, d), "start_us").where("dur_us > 0 AND dur_us <= 21600000000").groupBy("device", "zone").agg(F.min("start_us").alias("t"))
    return first.groupBy("device").agg(F.min(day_number(F.col("t"), _own())).alias("day"))


@query(f"WITH {V.LOCAL_RUNS}{V.LOCAL_TOTALS} SELECT device, day, CAST(CASE WHEN active_us + unattributed_us > 0 THEN active_us * 1000000 // (active_us + unattributed_us) END AS BIGINT) AS identified_ppm, CAST(observed_us * 1000000 // (observed_us + unobserved_us) AS BIGINT) AS observed_ppm FROM totals")
def local_day_metrics(spark, d):
    front = "active_us + unattributed_us"
    identified, observed = F.expr(f"CASE WHEN {front} > 0 THEN active_us * 1000000 div ({front}) END"), F.expr("observed_us * 1000000 div (observed_us + unobserved_us)")
    return A.state_totals(_runs(spark, d), _own()).select("device", "day", identified.alias("identified_ppm"), observed.alias("observed_ppm"))


@query(f"WITH {V.LOCAL_RUNS}{V.LOCAL_TOTALS}, sp AS (SELECT device, unnest(range(m - 6, m + 1)) AS day FROM (SELECT device, max(day) AS m FROM totals GROUP BY device)) SELECT sp.device, sp.day, observed_us, observed_us IS NULL AS missing FROM sp LEFT JOIN totals USING (device, day)")
def local_week(spark, d):
    return R.densify_week(A.state_totals(_runs(spark, d), _own())).select("device", "day", "observed_us", "missing")


@query(
    f"""WITH {V.LOCAL_RUNS}, {HOURS}, hs AS (SELECT device, day, hour, sum(us) / 1e6 AS s FROM h WHERE state = 'active' GROUP BY ALL), sp AS (SELECT device, day, unnest(range(24)) AS hour FROM (SELECT DISTINCT device, day FROM runs))
    SELECT device, day, hour, CAST(CASE WHEN s IS NULL THEN NULL WHEN s <= 0 THEN 0 WHEN s < 900 THEN 1 WHEN s < 1800 THEN 2 WHEN s < 2700 THEN 3 ELSE 4 END AS BIGINT) AS level, s IS NULL AS missing FROM sp LEFT JOIN hs USING (device, day, hour)"""
)
def local_heatmap(spark, d):
    hours = A.local_hours(_runs(spark, d), _own()).groupBy("device", "day", "hour", "state").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    return R.week_heatmap(hours)


@query(
    f"""WITH {V.FRAMES}, dd AS (SELECT id, {V.local_sql('at_us + ' + V.SHIFT_SQL, V.ZONE_SQL)} // 86400000000 AS day FROM frames), md AS (SELECT max(day) AS d1, (SELECT max(day) FROM dd WHERE day < (SELECT max(day) FROM dd)) AS d2 FROM dd)
    SELECT id, day, CASE WHEN day = d1 THEN 'test' WHEN day = d2 THEN 'validation' ELSE 'train' END AS split FROM dd, md"""
)
def local_split(spark, d):
    return K.temporal_split(V.zoned(V.frames(spark, d), "at_us").select("id", day_number(F.col("at_us"), _own()).alias("day")), "day")
