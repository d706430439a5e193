"""Views of the provided tables as observation tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.time import micros

EPOCH_2024 = 1_704_067_200_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str, scale: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    t = F.col("event_type")
    state = F.when(t.isin("view", "click"), "active").when(t == "purchase", "unattributed").when(t == "signup", "idle").otherwise("locked")
    told = e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 4).alias("device"),
        micros("ts").alias("start_us"),
        F.round(F.col("value") * F.lit(float(scale))).cast("long").alias("dur_us"),
        state.alias("state"),
        k.alias("k"),
        t.alias("event_type"),
    )
    front = F.col("state").isin("active", "unattributed")
    return told.withColumns({"app": F.when(front, F.concat(F.lit("app"), (F.col("k") % 2).cast("string"))), "win": F.when(F.col("state") == "active", F.concat(F.lit("w"), (F.floor(F.col("k") / 2) % 2).cast("string")))})


def samples(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "20e6").drop("event_type")


def short_samples(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "1e6").drop("event_type")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where("dur_us > 0 AND dur_us <= 21600000000")
    return s.select("id", "device", "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"), F.concat(F.lit("a"), (F.col("k") % 5).cast("string")).alias("app"))


def tabs(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d, "20e6").where(F.col("event_type").isin("view", "error"))
    day = F.floor(F.col("start_us") / 86_400_000_000)
    return e.select("id", "device", day.alias("day"), "start_us", F.concat(F.lit("h"), (F.col("k") % 7).cast("string")).alias("site"), (F.col("event_type") == "view").alias("focused"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    at = EPOCH_2024 + (F.col("doc_id") % 100) * 10_000_000 + F.floor(F.col("doc_id") / 100) * 259_200_000_000
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("device"), at.alias("at_us"), F.col("source").alias("app"), F.col("lang").alias("display"), "text", "n_chars")


def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("topic"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("device"), (F.col("vec_id") * 10_000_000).alias("at_us"), F.concat(F.lit("app"), (F.floor(F.col("vec_id") / 100) % 2).cast("string")).alias("app"), (F.col("vec_id") % 9 != 0).alias("eligible"), F.col("embedding").alias("vector"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("repo"), F.col("o_orderkey").alias("sha"), micros("o_orderdate").alias("at_us"), (F.col("o_custkey") % 7).alias("author"), (F.col("o_custkey") % 5).alias("committer"))


def file_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    ext = F.when(k % 9 == 0, ".LOG").when(k % 7 == 0, ".pyc").when(k % 10 == 3, ".sqlite3-wal").otherwise(".py")
    head = F.when(k % 11 == 0, "build/").when(k % 13 == 0, ".cache/").when(k % 17 == 0, "web/out/").when(k % 19 == 0, "./src/").otherwise("src/")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("root"), F.concat(head, F.lit("f"), F.col("l_partkey").cast("string"), ext).alias("path"), F.col("l_returnflag").alias("kind"), micros("l_shipdate").alias("at_us"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    start = micros("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), start.alias("start_us"), (start + (F.col("o_orderkey") % 1800) * 60_000_000).alias("end_us"), (F.col("o_orderkey") % 11 == 0).alias("all_day"), (F.col("o_custkey") % 6).alias("calendar"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "O", "incomplete").when(F.col("l_returnflag") == "A", "filtered").otherwise("complete")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") % 2).cast("long").alias("model"), F.col("l_linenumber").cast("long").alias("n"), status.alias("status"), F.col("l_quantity").alias("elapsed_s"), micros("l_shipdate").alias("at_us"))


def receipts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(micros("o_orderdate").alias("started_us"), F.floor(micros("o_orderdate") / 86_400_000_000).alias("night"), (F.col("o_orderkey") % 90).alias("completed"), (F.col("o_orderkey") % 7).alias("failed"), F.floor(F.col("o_totalprice")).cast("long").alias("elapsed_cs"))


SAMPLES = """samples AS (
  SELECT id, device, start_us, dur_us, state, k,
    CASE WHEN state IN ('active', 'unattributed') THEN 'app' || (k % 2)::VARCHAR END AS app,
    CASE WHEN state = 'active' THEN 'w' || ((k // 2) % 2)::VARCHAR END AS win
  FROM (SELECT event_id AS id, user_id % 4 AS device, epoch_us(ts) AS start_us, CAST(round(value * 20e6) AS BIGINT) AS dur_us,
    CASE WHEN event_type IN ('view', 'click') THEN 'active' WHEN event_type = 'purchase' THEN 'unattributed' WHEN event_type = 'signup' THEN 'idle' ELSE 'locked' END AS state,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type FROM events))"""

RUNS = (
    SAMPLES
    + """, dayed AS (
  SELECT id, device, state, app, win, k, start_us AS from_us, day, greatest(start_us, day * 86400000000) AS start_us, least(start_us + dur_us, (day + 1) * 86400000000) AS end_us
  FROM (SELECT *, unnest(range(start_us // 86400000000, (start_us + dur_us - 1) // 86400000000 + 1)) AS day FROM samples WHERE dur_us > 0 AND dur_us <= 21600000000)),
runs AS (
  SELECT id, device, day, state, app, win, k, start_us, end_us FROM (
    SELECT * REPLACE (least(end_us, coalesce(lead(start_us) OVER (PARTITION BY device, day ORDER BY start_us, from_us, id), end_us)) AS end_us) FROM dayed) WHERE end_us > start_us)"""
)

SEGMENTS = (
    RUNS
    + """, marked AS (
  SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state AND lag(app) OVER w IS NOT DISTINCT FROM app AND lag(win) OVER w IS NOT DISTINCT FROM win
    AND start_us - lag(end_us) OVER w BETWEEN 0 AND 2000000 THEN 0 ELSE 1 END AS new
  FROM runs WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY device, day ORDER BY start_us) AS BIGINT) AS island FROM marked),
segments AS (
  SELECT device, day, island, min(start_us) AS start_us, max(end_us) AS end_us, first(state ORDER BY start_us) AS state, first(app ORDER BY start_us) AS app,
    first(win ORDER BY start_us) AS win, count(*) AS samples, CAST(sum(end_us - start_us) AS BIGINT) AS sampled_us
  FROM numbered GROUP BY device, day, island)"""
)

STRETCHES = (
    SEGMENTS
    + """, told AS (
  SELECT *, CASE WHEN state = 'active' AND sampled_us > 0 THEN app || '/' || win END AS context FROM segments),
linked AS (
  SELECT *, coalesce(lag(context) OVER w = context AND start_us - lag(end_us) OVER w BETWEEN 0 AND 1000000, false) AS same
  FROM told WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
counted AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY device, day ORDER BY start_us) AS stretch FROM linked),
stretches AS (
  SELECT device, day, first(context ORDER BY start_us) AS context, min(start_us) AS start_us, max(end_us) AS end_us, CAST(sum(sampled_us) AS BIGINT) AS us, count(*) AS parts
  FROM counted WHERE context IS NOT NULL GROUP BY device, day, stretch),
measures AS (
  SELECT device, day, count(*) AS sessions, CAST(sum(sw) AS BIGINT) AS switches, CAST(sum(us) AS BIGINT) AS us, max(us) AS longest_us, median(us) AS median_us,
    count(*) FILTER (us >= 1200000000) AS sustained, count(*) FILTER (us < 120000000) AS brief
  FROM (SELECT *, CASE WHEN lag(context) OVER (PARTITION BY device, day ORDER BY start_us) <> context THEN 1 ELSE 0 END AS sw FROM stretches) GROUP BY device, day)"""
)

TOTALS = """, totals AS (
  SELECT device, day, {sums}, CAST(sum(end_us - start_us) AS BIGINT) AS observed_us, greatest(0, 86400000000 - CAST(sum(end_us - start_us) AS BIGINT)) AS unobserved_us
  FROM runs GROUP BY device, day)""".format(sums=", ".join(f"CAST(sum(CASE WHEN state = '{s}' THEN end_us - start_us ELSE 0 END) AS BIGINT) AS {s}_us" for s in ("active", "unattributed", "locked", "idle")))

SESSIONS = (
    SAMPLES
    + """, sessions AS (
  SELECT id, device, start_us, start_us + dur_us AS end_us, 'a' || (k % 5)::VARCHAR AS app FROM samples WHERE dur_us > 0 AND dur_us <= 21600000000)"""
)

SESSION_DAYS = """, parts AS (
  SELECT id, device, app, day, greatest(start_us, day * 86400000000) AS start_us, least(end_us, (day + 1) * 86400000000) AS end_us
  FROM (SELECT *, unnest(range(start_us // 86400000000, (end_us - 1) // 86400000000 + 1)) AS day FROM sessions)),
own AS (SELECT device, day, app, CAST(sum(greatest(0, end_us - greatest(start_us, coalesce(reach, start_us)))) AS BIGINT) AS app_union_us FROM (
  SELECT *, max(end_us) OVER (PARTITION BY device, day, app ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM parts) GROUP BY ALL),
whole AS (SELECT device, day, CAST(sum(greatest(0, end_us - greatest(start_us, coalesce(reach, start_us)))) AS BIGINT) AS device_union_us FROM (
  SELECT *, max(end_us) OVER (PARTITION BY device, day ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM parts) GROUP BY ALL),
summary AS (
  SELECT device, day, app, count(*) AS sessions, CAST(sum(end_us - start_us) AS BIGINT) AS raw_us, any_value(app_union_us) AS app_union_us, any_value(device_union_us) AS device_union_us,
    CAST(sum(end_us - start_us) AS BIGINT) - any_value(app_union_us) AS overlap_us
  FROM parts JOIN own USING (device, day, app) JOIN whole USING (device, day) GROUP BY device, day, app)"""

FRAMES = f"""frames AS (
  SELECT doc_id AS id, doc_id % 4 AS device, {EPOCH_2024} + (doc_id % 100) * 10000000 + (doc_id // 100) * 259200000000 AS at_us, source AS app, lang AS display, text, n_chars FROM documents)"""

COMMITS = "commits AS (SELECT o_custkey % 20 AS repo, o_orderkey AS sha, epoch_us(o_orderdate) AS at_us, o_custkey % 7 AS author, o_custkey % 5 AS committer FROM orders)"

FILES = """files AS (
  SELECT l_suppkey AS root, CASE WHEN l_partkey % 11 = 0 THEN 'build/' WHEN l_partkey % 13 = 0 THEN '.cache/' WHEN l_partkey % 17 = 0 THEN 'web/out/' WHEN l_partkey % 19 = 0 THEN './src/' ELSE 'src/' END || 'f' || l_partkey::VARCHAR ||
    CASE WHEN l_partkey % 9 = 0 THEN '.LOG' WHEN l_partkey % 7 = 0 THEN '.pyc' WHEN l_partkey % 10 = 3 THEN '.sqlite3-wal' ELSE '.py' END AS path, l_returnflag AS kind, epoch_us(l_shipdate) AS at_us,
    l_partkey % 11 <> 0 AND l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 9 <> 0 AND (l_partkey % 7 = 0 OR l_partkey % 10 <> 3) AS work FROM lineitem)"""

CALENDAR = """calendar AS (
  SELECT o_orderkey AS id, epoch_us(o_orderdate) AS start_us, epoch_us(o_orderdate) + (o_orderkey % 1800) * 60000000 AS end_us, o_orderkey % 11 = 0 AS all_day, o_custkey % 6 AS calendar FROM orders)"""

ANNOTATIONS = """annotations AS (
  SELECT l_orderkey AS path, CAST(l_linenumber % 2 AS BIGINT) AS model, CAST(l_linenumber AS BIGINT) AS n,
    CASE WHEN l_linestatus = 'O' THEN 'incomplete' WHEN l_returnflag = 'A' THEN 'filtered' ELSE 'complete' END AS status, l_quantity AS elapsed_s, epoch_us(l_shipdate) AS at_us FROM lineitem)"""

RECEIPTS = """receipts AS (
  SELECT epoch_us(o_orderdate) AS started_us, epoch_us(o_orderdate) // 86400000000 AS night, o_orderkey % 90 AS completed, o_orderkey % 7 AS failed, CAST(floor(o_totalprice) AS BIGINT) AS elapsed_cs FROM orders)"""


def screens(spark: SparkSession, d: str) -> DataFrame:
    """Frames with an app, a window title and a reading status; some lack one or the other."""
    i = F.col("id")
    app, win = F.when(i % 9 != 0, F.concat(F.lit("app"), (i % 2).cast("string"))), F.when(i % 3 != 0, F.concat(F.lit("w"), (F.floor(i / 2) % 2).cast("string")))
    return frames(spark, d).select("id", "device", "at_us", app.alias("app"), win.alias("win"), "text", F.when(F.col("n_chars") % 10 == 0, "pending").otherwise("complete").alias("status"))


SCREENS = (
    FRAMES
    + """, screens AS (SELECT id, device, at_us, CASE WHEN id % 9 <> 0 THEN 'app' || (id % 2)::VARCHAR END AS app, CASE WHEN id % 3 <> 0 THEN 'w' || ((id // 2) % 2)::VARCHAR END AS win, text, CASE WHEN n_chars % 10 = 0 THEN 'pending' ELSE 'complete' END AS status FROM frames)"""
)


def captions(spark: SparkSession, d: str) -> DataFrame:
    """One caption for each attempt on a frame."""
    a = annotations(spark, d)
    return a.select(F.col("path").alias("id"), F.col("n").alias("ord"), "status", F.concat_ws(" ", F.lit("view"), "status", F.col("n").cast("string")).alias("caption"), F.when(F.col("model") == 1, "strong").otherwise("weak").alias("model"))


CAPTIONS = (
    ANNOTATIONS
    + """, captions AS (SELECT path AS id, n AS ord, status, 'view ' || status || ' ' || n::VARCHAR AS caption, CASE WHEN model = 1 THEN 'strong' ELSE 'weak' END AS model FROM annotations)"""
)


#: Where devices are, and how many days their times are moved, so that both clock changes of 2024 lie among them.
ZONES = {0: ("America/Chicago", 60), 1: ("America/Chicago", 290), 2: ("Europe/Berlin", 80), 3: ("Asia/Kolkata", 0)}


def zoned(df: DataFrame, *times: str) -> DataFrame:
    """Rows of devices with their zone, times moved by ZONES."""
    zone, shift = F.lit("UTC"), F.lit(0).cast("long")
    for device, (name, days) in ZONES.items():
        own = F.col("device") == device
        zone, shift = F.when(own, name).otherwise(zone), F.when(own, days * 86_400_000_000).otherwise(shift)
    return df.withColumns({"zone": zone} | {t: F.col(t) + shift for t in times})


ZONE_SQL = "CASE device " + " ".join(f"WHEN {d} THEN '{z}'" for d, (z, _) in ZONES.items()) + " ELSE 'UTC' END"
SHIFT_SQL = "CASE device " + " ".join(f"WHEN {d} THEN {n * 86_400_000_000}" for d, (_, n) in ZONES.items()) + " ELSE 0 END"


def local_sql(us: str, zone: str = "zone") -> str:
    """A zone's clock in microseconds, in SQL."""
    return f"epoch_us(timezone({zone}, timezone('UTC', make_timestamp(({us})::BIGINT))))"


def day_start_sql(day: str, zone: str = "zone") -> str:
    return f"epoch_us(timezone({zone}, make_timestamp((({day}) * 86400000000)::BIGINT)))"


def days_sql(rows: str, into: str) -> str:
    """CTEs that cut rows (start_us, end_us, zone, ...) at local midnights."""
    return f"""{into}_d AS (SELECT *, unnest(range({local_sql('start_us')} // 86400000000, {local_sql('end_us - 1')} // 86400000000 + 1)) AS day FROM {rows} WHERE end_us > start_us),
  {into}_b AS (SELECT *, start_us AS from_us, {day_start_sql('day')} AS low_us, {day_start_sql('day + 1')} AS high_us FROM {into}_d),
  {into} AS (SELECT * REPLACE (greatest(start_us, low_us) AS start_us, least(end_us, high_us) AS end_us) FROM {into}_b WHERE least(end_us, high_us) > greatest(start_us, low_us))"""


LOCAL_RUNS = (
    SAMPLES
    + f""", zoned AS (SELECT id, device, state, app, win, k, start_us + {SHIFT_SQL} AS start_us, start_us + {SHIFT_SQL} + dur_us AS end_us, {ZONE_SQL} AS zone FROM samples WHERE dur_us > 0 AND dur_us <= 21600000000),
  {days_sql('zoned', 'zoned_days')},
  runs AS (SELECT id, device, day, state, app, win, k, zone, low_us, high_us, start_us, end_us FROM (
    SELECT * REPLACE (least(end_us, coalesce(lead(start_us) OVER (PARTITION BY device, day ORDER BY start_us, from_us, id), end_us)) AS end_us) FROM zoned_days) WHERE end_us > start_us)"""
)
#: What follows from runs is the same text as for UTC days.
LOCAL_STRETCHES = LOCAL_RUNS + STRETCHES[len(RUNS) :]
LOCAL_TOTALS = TOTALS.replace("86400000000 - CAST(sum(end_us - start_us) AS BIGINT)", "max(high_us - low_us) - CAST(sum(end_us - start_us) AS BIGINT)")
LOCAL_SESSIONS = f"""sessions AS (SELECT id, device, start_us, end_us, zone, 'a' || (k % 5)::VARCHAR AS app FROM zoned),
  {days_sql('sessions', 'parts')}{SESSION_DAYS[SESSION_DAYS.index(",\nown AS") :]}"""
