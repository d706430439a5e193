"""Queries that run as streams over all there is, against SQL for what a batch would give."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.time import HOUR, MINUTE, SECOND
from spanloom.operators import ledger as G
from spanloom.plans.book import Book
from spanloom.plans.queries_activity import _runs, _segs
from spanloom.plans.queries_ledger import FRESH, FRESH_NOW, HEALTH, _limits
from spanloom.plans.queries_rank import CADENCE
from spanloom.sources import adapters as V
from spanloom.sources.scratch import scratch, written
from spanloom.streaming import streams as T

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql


def _stream(spark, d, name):
    # A pattern, since a stream takes a plain path for a folder, and a table may be one file.
    return T.source(spark, f"{d}/{name}.parque[t]", V.table(spark, d, name).schema)


def _events(spark, d):
    e = _stream(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("device"), "user_id", "event_type", V.micros("ts").alias("at_us"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))


def _appended(spark, df, close=None):
    """What a stream has appended once all input is there; close() then adds a last row to it, in a run of its own."""
    path = scratch(spark)
    T.run_once(df, f"{path}/out", f"{path}/checkpoint")
    if close is not None:
        close()
        T.run_once(df, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _closing(spark, df, at, end=V.EPOCH_2024 + 4000 * 24 * HOUR, **keys):
    """df, and what adds a heartbeat to it, long after all other rows: it lets the watermark pass them, and is never out."""
    path = scratch(spark)
    spark.createDataFrame([], df.schema).write.parquet(path)

    def close():
        told = {at: end} | keys
        spark.range(1).select(*[F.lit(told.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]).write.mode("append").parquet(path)

    return df.unionByName(T.source(spark, path, df.schema)), close


#: The tables are in no order of time: rows wait for the whole of their month.
WAIT = "40 days"


def _whole(rows, at):
    """The delay and the heartbeat of a stream over rows in no order of time: all wait for the last one, however long the table lasts."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    span = 0 if low is None else high - low
    return f"{span // SECOND + 1} seconds", (V.EPOCH_2024 if low is None else high) + span + 2 * SECOND


def _replay(spark, rows):
    """Rows that a batch derives, as a stream."""
    t = written(rows)
    return T.source(spark, t.written_at, t.schema)


@query("SELECT event_id AS id, user_id % 4 AS device, event_type, epoch_us(ts) AS at_us FROM events")
def ingest_stream(spark, d):
    """Samples that arrive twice, taken once."""
    e = _events(spark, d).select("id", "device", "event_type", "at_us", F.timestamp_micros("at_us").alias("at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).drop("copy")
    return _appended(spark, T.ingest(e)).select("id", "device", "event_type", "at_us")


@query(
    f"""WITH RECURSIVE o AS (SELECT event_id AS id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT id, user_id, event_type, us, r, us AS kept, true AS keep FROM o WHERE r = 1 UNION ALL SELECT o.id, o.user_id, o.event_type, o.us, o.r, CASE WHEN o.us - f.kept >= {24 * HOUR} THEN o.us ELSE f.kept END, o.us - f.kept >= {24 * HOUR} FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.r = f.r + 1)
    SELECT id, user_id, event_type, us AS at_us, coalesce(r - lag(r) OVER (PARTITION BY user_id, event_type ORDER BY r) - 1, 0) AS dropped FROM f WHERE keep"""
)
def coalesce_files(spark, d):
    """Events of one key within a span of the last kept one are dropped and counted."""
    events, close = _closing(spark, _events(spark, d), "at_us", user_id=-1, event_type="end")
    return _appended(spark, T.coalesce(events, ["user_id", "event_type"], 24 * HOUR, WAIT), close)


@query(
    f"""WITH RECURSIVE o AS (SELECT event_id AS id, user_id AS device, epoch_us(ts) AS us, event_type AS identity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT id, device, us, r, identity AS i0, us AS u0, true AS keep FROM o WHERE r = 1 UNION ALL SELECT id, device, us, r, CASE WHEN again THEN i0 ELSE identity END, CASE WHEN again THEN u0 ELSE us END, NOT again FROM (SELECT o.*, f.i0, f.u0, o.identity = f.i0 AND o.us - f.u0 < {12 * HOUR} AS again FROM f JOIN o ON o.device = f.device AND o.r = f.r + 1))
    SELECT device, id, us AS at_us FROM f WHERE keep"""
)
def tab_dedupe(spark, d):
    """A tab's event goes if it repeats the last one sent within a span."""
    events, close = _closing(spark, _events(spark, d).withColumn("device", F.col("user_id")).withColumn("identity", F.col("event_type")), "at_us", device=-1)
    return _appended(spark, T.tab_dedupe(events, ["device"], 12 * HOUR, WAIT), close)


@query(CADENCE)
def frame_cadence(spark, d):
    """The cadence rules as a stream."""
    i = F.col("doc_id")
    at = V.EPOCH_2024 + (i % 100) * 10 * SECOND + F.floor(i / 100) * 259_200 * SECOND
    f = _stream(spark, d, "documents").select(i.alias("id"), (i % 4).alias("device"), at.alias("at_us"), F.col("lang").alias("context"), (F.col("n_chars") % 3).alias("digest"), (F.col("n_chars") / 100.0).alias("level"))
    delay, end = _whole(V.table(spark, d, "documents").select(at.alias("at_us")), "at_us")
    frames, close = _closing(spark, f, "at_us", end, device=-1)
    return _appended(spark, T.frame_cadence(frames, ["device"], change=10.0, delay=delay), close)


@query(HEALTH + " SELECT id, device, CAST(windows AS BIGINT) AS windows, CAST(untitled AS BIGINT) AS untitled FROM h")
def identity_health_stream(spark, d):
    """Windows and untitled ones among each device's last 60 samples, as samples come in."""
    k, t = F.col("k"), F.col("event_type")
    window = F.when(k % 100 < 76 + F.col("device") * 3, "unattributed").otherwise("active")
    state = F.when(t.isin("view", "click", "purchase"), window).when(t == "signup", "idle").otherwise("locked")
    samples, close = _closing(spark, _events(spark, d).withColumn("state", state), "at_us", device=-1)
    path = scratch(spark)
    T.identity_samples(samples, f"{path}/out", f"{path}/checkpoint", delay=WAIT)
    close()
    T.identity_samples(samples, f"{path}/out", f"{path}/checkpoint", delay=WAIT)
    return spark.read.schema("device long, id long, windows long, untitled long").parquet(f"{path}/out/*")


@query(f"WITH {V.STRETCHES} SELECT device, day, context, start_us, end_us, us, parts FROM stretches")
def context_session_stream(spark, d):
    """Sessions that a change of context ends, or a silence that the watermark has passed."""
    context = F.when((F.col("state") == "active") & (F.col("sampled_us") > 0), F.concat_ws("/", "app", "win"))
    told = _segs(spark, d).select("device", "day", "start_us", "end_us", context.alias("context"), F.col("sampled_us").alias("us"))
    parts, close = _closing(spark, _replay(spark, told), "start_us", device=-1, day=-1)
    return _appended(spark, T.context_sessions(parts, ["device", "day"], SECOND, WAIT), close)


@query(
    f"""WITH e AS (SELECT DISTINCT user_id AS source, event_type AS kind, epoch_us(ts) AS us FROM events), n AS (SELECT *, lag(us) OVER w AS before, lead(us) OVER w AS after FROM e WINDOW w AS (PARTITION BY source, kind ORDER BY us))
    SELECT source, kind, us AS at_us, 'fresh' AS status FROM n WHERE before IS NULL OR us - before > {12 * HOUR} UNION ALL SELECT source, kind, us + {12 * HOUR}, 'stale' FROM n WHERE after IS NULL OR after - us > {12 * HOUR}"""
)
def freshness_stream(spark, d):
    """When each source and kind becomes fresh and, by a timer, stale."""
    receipts, close = _closing(spark, _events(spark, d).select(F.col("user_id").alias("source"), F.col("event_type").alias("kind"), "at_us"), "at_us", source=-1, kind="end")
    return _appended(spark, T.freshness_changes(receipts, ["source", "kind"], 12 * HOUR, WAIT), close)


@query(f"WITH {V.RUNS}, c AS (SELECT device, state, slot, least(end_us, (slot + 1) * 300000000) - greatest(start_us, slot * 300000000) AS us FROM (SELECT *, unnest(range(start_us // 300000000, (end_us - 1) // 300000000 + 1)) AS slot FROM runs)) SELECT device, state, slot * 300000000 AS start_us, CAST(sum(us) AS BIGINT) AS us FROM c GROUP BY ALL")
def tumbling_activity(spark, d):
    """Time by state in bins of five minutes, closed by the watermark; a last heartbeat closes the last ones."""
    runs = _runs(spark, d).select("device", "state", "start_us", "end_us")
    rows, close = _closing(spark, _replay(spark, runs), "start_us", device=-1, state="end", end_us=V.EPOCH_2024 + 4000 * 24 * HOUR + SECOND)
    return _appended(spark, T.tumbling(rows, delay=WAIT), close).where("device >= 0")


@query(
    f"""WITH e AS (SELECT user_id AS device, epoch_us(ts) AS us, event_id FROM events), n AS (SELECT *, CASE WHEN us - lag(us) OVER w < {12 * HOUR} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY device ORDER BY us, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY us, event_id) AS s FROM n)
    SELECT device, min(us) AS start_us, max(us) + {12 * HOUR} AS end_us, count(*) AS events FROM s GROUP BY device, s"""
)
def session_stream(spark, d):
    """Sessions with gaps below twelve hours, closed by the watermark."""
    e = V.table(spark, d, "events").select(F.col("user_id").alias("device"), V.micros("ts").alias("us"))
    rows, close = _closing(spark, _replay(spark, e), "us", device=-1)
    return _appended(spark, T.sessions(rows.withColumn("at", F.timestamp_micros("us")), "12 hours", WAIT), close).where("device >= 0")


@query(f"WITH e AS (SELECT user_id % 4 AS device, epoch_us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * {30 * MINUTE} AS late FROM events) SELECT DISTINCT device, us // 86400000000 AS day, CASE WHEN late > {36 * HOUR} THEN 'backfill' WHEN late > {6 * HOUR} THEN 'late' ELSE 'current' END AS kind FROM e")
def late_data(spark, d):
    """Days that arriving rows touch, and how late these were."""
    path = scratch(spark)
    e = _events(spark, d).withColumn("received_us", F.col("at_us") + F.col("k") * 30 * MINUTE)
    T.mark_touched(T.lateness(e, "at_us", "received_us"), f"{path}/out", f"{path}/checkpoint", ["device", "day", "kind"])
    return spark.read.schema("device long, day long, kind string").parquet(f"{path}/out").distinct()


@query(FRESH)
def source_freshness(spark, d):
    """The age rules of receipt_fresh, over the last receipts that a stream keeps."""
    path = scratch(spark)
    r = _events(spark, d).select(F.col("user_id").alias("source"), F.col("event_type").alias("kind"), "at_us")
    T.run_complete(T.last_receipts(r, ["source", "kind"]), f"{path}/out", f"{path}/checkpoint")
    last = spark.read.schema("source long, kind string, at_us long").parquet(f"{path}/out")
    return G.freshness(last, _limits(spark), FRESH_NOW, ["source"])
