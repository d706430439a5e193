"""Queries of the ledger's rules: states, scope, receipts, exports, health of sources, ids and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.time import DAY, HOUR, MINUTE, SECOND, local_bounds as _local_bounds, temporal_key as _temporal_key
from spanloom.operators import ledger as G
from spanloom.operators import review as W
from spanloom.operators.asof import asof
from spanloom.plans.book import Book
from spanloom.plans.queries_activity import _runs
from spanloom.plans.queries_text import _clean, _one, _q
from spanloom.sources import adapters as V
from spanloom.sources import ingest as S
from spanloom.sources.scratch import scratch

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql

ZONE = "America/Chicago"
K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def _events(spark, d):
    return V.table(spark, d, "events").withColumns({"k": F.regexp_extract("props", "([0-9]+)", 1).cast("long"), "device": F.col("user_id") % 4, "us": V.micros("ts")})


RAW = f"""raw AS (SELECT event_id AS id, {K} AS k, CASE event_type WHEN 'view' THEN 'window' WHEN 'click' THEN 'window_legacy' WHEN 'purchase' THEN 'window' WHEN 'signup' THEN CASE WHEN {K} % 2 = 0 THEN 'idle' ELSE 'idle_legacy' END ELSE CASE WHEN {K} % 10 = 0 THEN 'browser' ELSE 'locked' END END AS source,
    CASE WHEN event_type = 'purchase' THEN NULL WHEN {K} % 4 = 0 THEN '' ELSE 'w' || ({K} % 3)::VARCHAR END AS title, CASE WHEN {K} % 7 <> 0 THEN 'app' || ({K} % 2)::VARCHAR END AS app, CASE WHEN {K} % 5 = 0 THEN 'h' || ({K} % 3)::VARCHAR END AS host FROM events)"""
STATE = "CASE WHEN source IN ('window', 'window_legacy') THEN CASE WHEN coalesce(title, '') = '' THEN 'unattributed' ELSE 'active' END WHEN source IN ('idle', 'idle_legacy') THEN 'idle' WHEN source = 'locked' THEN 'locked' END"


@query(f"WITH {RAW}, s AS (SELECT *, {STATE} AS state FROM raw) SELECT id, state, CASE WHEN state IN ('active', 'unattributed') THEN app END AS app, CASE WHEN state = 'active' THEN title END AS win, CASE WHEN state IN ('active', 'unattributed') THEN host END AS host FROM s WHERE state IS NOT NULL")
def derive_state(spark, d):
    """What a raw sample's source and title tell: state, and the fields that this state may have."""
    k, t = F.col("k"), F.col("event_type")
    source = F.when(t == "click", "window_legacy").when(t.isin("view", "purchase"), "window").when(t == "signup", F.when(k % 2 == 0, "idle").otherwise("idle_legacy")).otherwise(F.when(k % 10 == 0, "browser").otherwise("locked"))
    title = F.when(t == "purchase", None).when(k % 4 == 0, "").otherwise(F.concat(F.lit("w"), (k % 3).cast("string")))
    app, host = F.when(k % 7 != 0, F.concat(F.lit("app"), (k % 2).cast("string"))), F.when(k % 5 == 0, F.concat(F.lit("h"), (k % 3).cast("string")))
    told = _events(spark, d).select(F.col("event_id").alias("id"), T.derive_state(source, title).alias("state"), app.alias("app"), title.alias("title"), host.alias("host")).where("state IS NOT NULL")
    front = F.col("state").isin("active", "unattributed")
    return told.select("id", "state", F.when(front, F.col("app")).alias("app"), F.when(F.col("state") == "active", F.col("title")).alias("win"), F.when(front, F.col("host")).alias("host"))


@query(f"WITH x AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'My Bank Account' WHEN doc_id % 17 = 0 THEN 'keychains' END AS app, CASE WHEN doc_id % 19 = 0 THEN 'a one-time code' END AS win, text FROM documents) SELECT doc_id, regexp_matches(concat_ws(' ', app, win, text), {_q(T.SENSITIVE)}) AS sensitive FROM x")
def is_sensitive(spark, d):
    i = F.col("doc_id")
    app, win = F.when(i % 13 == 0, "My Bank Account").when(i % 17 == 0, "keychains"), F.when(i % 19 == 0, "a one-time code")
    return V.table(spark, d, "documents").select("doc_id", T.is_sensitive(app, win, F.col("text")).alias("sensitive"))


@query(
    f"""WITH x AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'KeePassXC' WHEN 1 THEN 'com.apple.passwords' WHEN 2 THEN 'My 1Password 8' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE c_mktsegment END AS app, CASE c_custkey % 5 WHEN 0 THEN 'Recovery Key for ' || c_name WHEN 1 THEN NULL ELSE c_name END AS win FROM customer)
    SELECT id, CASE WHEN coalesce(app, '') = '' THEN 'unknown_frontmost_app' WHEN lower(app) IN {T.SENSITIVE_APPS} OR regexp_matches(lower(app), '{'|'.join(T.SENSITIVE_VENDORS)}') THEN 'sensitive_app' WHEN coalesce(regexp_matches(lower(win), '{'|'.join(T.SENSITIVE_TITLES)}'), false) THEN 'sensitive_window_title' END AS code FROM x"""
)
def sensitive_context(spark, d):
    i = F.col("c_custkey")
    app = F.when(i % 7 == 0, "KeePassXC").when(i % 7 == 1, "com.apple.passwords").when(i % 7 == 2, "My 1Password 8").when(i % 7 == 4, "").when(i % 7 > 4, F.col("c_mktsegment"))
    win = F.when(i % 5 == 0, F.concat(F.lit("Recovery Key for "), "c_name")).when(i % 5 != 1, F.col("c_name"))
    return V.table(spark, d, "customer").select(i.alias("id"), T.sensitive_context(app, win).alias("code"))


@query(
    f"""WITH {V.SAMPLES}, s AS (SELECT id, device, start_us, start_us + CASE WHEN k % 31 = 0 THEN 0 ELSE dur_us END AS end_us, CASE WHEN k % 17 = 0 THEN 'away' ELSE state END AS state, dur_us - k % 5 // 4 AS sampled_us, k FROM samples),
    p AS (SELECT id, start_us, (start_us + end_us) // 2 AS end_us FROM s WHERE k % 19 <> 0 UNION ALL SELECT id, (start_us + end_us) // 2, end_us + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END FROM s WHERE k % 19 <> 0),
    t AS (SELECT s.*, count(p.start_us) AS parts, count(*) FILTER (NOT (s.start_us <= p.start_us AND p.start_us < p.end_us AND p.end_us <= s.end_us)) AS outside, sum(p.end_us - p.start_us) AS us FROM s LEFT JOIN p ON p.id = s.id GROUP BY ALL)
    SELECT id, 'unknown_state' AS code FROM t WHERE state NOT IN ('active', 'unattributed', 'idle', 'locked') UNION ALL SELECT id, 'not_positive' FROM t WHERE start_us >= end_us UNION ALL SELECT id, 'no_support' FROM t WHERE parts = 0
    UNION ALL SELECT id, 'support_outside' FROM t WHERE outside > 0 UNION ALL SELECT id, 'support_sum' FROM t WHERE parts > 0 AND us <> sampled_us
    UNION ALL SELECT id, 'overlap' FROM (SELECT id, start_us, max(end_us) OVER (PARTITION BY device ORDER BY start_us, end_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE end_us > start_us) WHERE start_us < reach"""
)
def validate_runs(spark, d):
    """Samples with their support in two halves; some have another state, length, sum or edge than they should."""
    k = F.col("k")
    s = V.samples(spark, d).withColumn("end_us", F.col("start_us") + F.when(k % 31 == 0, 0).otherwise(F.col("dur_us")))
    s = s.select("id", "device", "start_us", "end_us", F.when(k % 17 == 0, "away").otherwise(F.col("state")).alias("state"), (F.col("dur_us") - F.floor(k % 5 / 4)).alias("sampled_us"), "k")
    mid = F.floor((F.col("start_us") + F.col("end_us")) / 2)
    halves = F.array(F.struct(F.col("start_us").alias("start_us"), mid.alias("end_us")), F.struct(mid.alias("start_us"), (F.col("end_us") + F.when(k % 7 == 0, 1).otherwise(0)).alias("end_us")))
    support = s.where("k % 19 <> 0").select("id", F.explode(halves).alias("h")).select("id", "h.*")
    return G.validate_runs(s, support)


ITEMS = """ci AS (SELECT CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'reminder' ELSE 'event' END AS kind, o_custkey % 6 AS calendar, epoch_us(o_orderdate) AS start_us, epoch_us(o_orderdate) + (o_orderkey % 1800) * 60000000 AS end_us,
    CASE o_orderkey % 7 WHEN 0 THEN 'Doctor  visit' WHEN 1 THEN 'Team sync a@b.co' WHEN 2 THEN NULL WHEN 3 THEN 'Medicals' ELSE o_orderpriority END AS title FROM orders),
    scope AS (SELECT * FROM (VALUES ('event', 0, true), ('event', 1, false), ('event', 2, true), ('reminder', 3, true), ('reminder', 4, false)) AS t(kind, calendar, with_title))"""
CAL_NOW = 883_612_800_000_000
TOLD = f"""{ITEMS}, told AS (SELECT ci.*, with_title, CASE WHEN with_title IS NULL THEN 'unscoped' WHEN id IS NULL THEN 'no_id' WHEN coalesce(regexp_matches(title, {_q(T.HEALTH)}), false) THEN 'health' WHEN start_us NOT BETWEEN {CAL_NOW} - 366 * {DAY} AND {CAL_NOW} + 31 * {DAY} THEN 'outside' ELSE 'keep' END AS disposition,
    {_clean("left(" + _one("title") + ", 160)")} AS safe FROM ci LEFT JOIN scope USING (kind, calendar))"""


def _calendar(spark, d):
    i = F.col("o_orderkey")
    title = F.when(i % 7 == 0, "Doctor  visit").when(i % 7 == 1, "Team sync a@b.co").when(i % 7 == 3, "Medicals").when(i % 7 > 3, F.col("o_orderpriority"))
    start = V.micros("o_orderdate")
    items = V.table(spark, d, "orders").select(F.when(i % 29 != 0, i).alias("id"), F.when(i % 3 == 0, "reminder").otherwise("event").alias("kind"), (F.col("o_custkey") % 6).alias("calendar"), start.alias("start_us"), (start + (i % 1800) * MINUTE).alias("end_us"), title.alias("title"))
    scope = spark.createDataFrame([("event", 0, True), ("event", 1, False), ("event", 2, True), ("reminder", 3, True), ("reminder", 4, False)], "kind string, calendar long, with_title boolean")
    return G.calendar_items(items, scope, CAL_NOW)


@query(f"WITH {TOLD} SELECT sha256(concat_ws(':', kind, calendar, id)) AS row_id, kind, calendar, start_us, end_us, CASE WHEN with_title AND safe <> '' THEN safe END AS title FROM told WHERE disposition = 'keep'")
def import_calendar(spark, d):
    """Items of selected calendars near now, without health titles; a title only where its calendar shows it."""
    return _calendar(spark, d).where("disposition = 'keep'").select("row_id", "kind", "calendar", "start_us", "end_us", "title")


@query(f"WITH {TOLD} SELECT kind, disposition, count(*) AS rows FROM told GROUP BY ALL")
def calendar_dispositions(spark, d):
    return _calendar(spark, d).groupBy("kind", "disposition").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"""WITH m AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'tab_active' WHEN 'click' THEN 'tab_updated' WHEN 'purchase' THEN 'window_focused' WHEN 'signup' THEN 'browser_blur' ELSE 'other' END AS kind, epoch_us(ts) AS at_us, epoch_us(ts) + ({K} - 20) * 6000000 AS received_us,
      CASE {K} % 9 WHEN 0 THEN 'Bad Domain!' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'Site' || ({K} % 7)::VARCHAR || '.Example.com' END AS domain, {K} % 23 = 5 AS incognito, {K} * 45000000 - event_id % 50 AS tab_id FROM events),
    v AS (SELECT *, CASE WHEN incognito THEN 'incognito' WHEN kind = 'other' THEN 'bad_type' WHEN abs(received_us - at_us) > 300000000 THEN 'bad_clock' WHEN domain = 'Bad Domain!' THEN 'bad_domain' WHEN kind <> 'browser_blur' AND coalesce(domain, '') = '' THEN 'no_domain' WHEN tab_id < 0 OR tab_id >= 2147483648 THEN 'bad_id' ELSE 'accepted' END AS verdict FROM m)
    SELECT id, verdict, CASE WHEN verdict = 'accepted' AND domain <> '' THEN lower(domain) END AS site_host FROM v"""
)
def import_tab_events(spark, d):
    k, t = F.col("k"), F.col("event_type")
    kind = F.when(t == "view", "tab_active").when(t == "click", "tab_updated").when(t == "purchase", "window_focused").when(t == "signup", "browser_blur").otherwise("other")
    domain = F.when(k % 9 == 0, "Bad Domain!").when(k % 9 == 2, "").when(k % 9 > 2, F.concat(F.lit("Site"), (k % 7).cast("string"), F.lit(".Example.com")))
    m = _events(spark, d).select(F.col("event_id").alias("id"), kind.alias("kind"), F.col("us").alias("at_us"), (F.col("us") + (k - 20) * 6 * SECOND).alias("received_us"), domain.alias("domain"), (k % 23 == 5).alias("incognito"), (k * 45_000_000 - F.col("event_id") % 50).alias("tab_id"), F.lit(1).alias("window_id"))
    return G.tab_events(m).select("id", "verdict", "site_host")


@query("SELECT substr(sha256('store/' || (o_custkey % 97)::VARCHAR || '/git'), 1, 20) AS common_key, min(o_orderkey) AS store, count(*) AS candidates FROM orders GROUP BY ALL")
def discover_stores(spark, d):
    common = F.concat(F.lit("store/"), (F.col("o_custkey") % 97).cast("string"), F.lit("/git"))
    return G.discover_stores(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), common.alias("common_dir")))


TIMELINE = f"""{V.FRAMES}, tl AS (SELECT user_id % 4 AS device, epoch_us(ts) AS at_us, 'sample' AS source, event_id AS id FROM events UNION ALL SELECT device, at_us, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'frame' ELSE 'pending' END, id FROM frames)"""


def _timeline(spark, d):
    return S.timeline(V.samples(spark, d), V.frames(spark, d), V.tags(spark, d))


@query(f"WITH {TIMELINE} SELECT * FROM tl")
def union_timeline(spark, d):
    """Samples, finished frames and pending ones as one stream."""
    return _timeline(spark, d)


@query(f"""WITH {TIMELINE}, l AS (SELECT device, source, '{{"device":' || device::VARCHAR || ',"at_us":' || at_us::VARCHAR || ',"source":"' || source || '","id":' || id::VARCHAR || '}}' AS line FROM tl) SELECT device, source, count(*) AS rows, CAST(sum(length(line) + 1) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM l GROUP BY ALL""")
def export_timeline(spark, d):
    """The manifest of the timeline as it was written: rows, bytes and digest of its JSON lines."""
    return S.export_lines(_timeline(spark, d), scratch(spark))


@query("SELECT o_orderkey AS id, 2 AS version, o_orderkey % 90 AS completed, epoch_us(o_orderdate) AS at_us FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 17 <> 0")
def read_receipts(spark, d):
    """Receipts written as JSON lines, some broken, some of another version, some too large, and read back."""
    i, path = F.col("o_orderkey"), scratch(spark)
    body = F.to_json(F.struct(F.when(i % 7 == 0, 1).otherwise(2).alias("version"), i.alias("id"), (i % 90).alias("completed"), V.micros("o_orderdate").alias("at_us"), F.when(i % 17 == 0, F.repeat(F.lit("x"), 2000)).alias("note")))
    V.table(spark, d, "orders").select(F.when(i % 13 == 0, F.left(body, F.lit(15))).otherwise(body).alias("value")).write.text(path)
    return S.read_receipts(spark, path, "version INT, id LONG, completed LONG, at_us LONG", 2, 1000)


@query("SELECT user_id % 4 AS device, count(*) AS rows, CAST(sum(CASE WHEN user_id % 4 = 2 THEN event_id + 1 ELSE event_id END) AS BIGINT) AS total, user_id % 4 = 2 AS rewritten FROM events GROUP BY ALL")
def write_if_changed(spark, d):
    """A table written twice, with one device changed in between: only its partition is written again."""
    path = scratch(spark)
    rows = _events(spark, d).select("device", F.col("event_id").alias("id"))
    S.write_changed(rows, path, ["device"])
    again = S.write_changed(rows.withColumn("id", F.when(F.col("device") == 2, F.col("id") + 1).otherwise(F.col("id"))), path, ["device"])
    now = spark.read.schema("id long, device long").parquet(path).groupBy("device").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("total"))
    return now.join(again.withColumn("rewritten", F.lit(True)), "device", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(False)))


@query("SELECT epoch_us(ts) // 86400000000 AS day, count(*) + count(*) FILTER (event_type = 'error') AS lines, CAST(sum(event_id) + coalesce(sum(event_id) FILTER (event_type = 'error'), 0) AS BIGINT) AS ids FROM events GROUP BY ALL")
def append_history(spark, d):
    """All checks appended to their days' files, and errors once more; then what the files hold."""
    path = scratch(spark)
    rows = _events(spark, d).select(F.col("event_id").alias("id"), "event_type", "us")
    S.append_history(rows, path, F.floor(F.col("us") / DAY))
    S.append_history(rows.where("event_type = 'error'"), path, F.floor(F.col("us") / DAY))
    back = spark.read.schema("id long, event_type string, us long, day long").json(path)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("lines"), F.sum("id").alias("ids"))


LIMITS = {"view": 120, "click": 30, "purchase": 5400, "signup": 1800, "error": 93600, "heartbeat": 900}
FRESH_NOW = 1_706_659_200_000_000 - 600 * SECOND
FRESH = f"""WITH lim AS (SELECT unnest({list(LIMITS)}) AS kind, unnest({list(LIMITS.values())}) * 1000000::BIGINT AS limit_us), r AS (SELECT user_id AS source, event_type AS kind, max(epoch_us(ts)) AS at_us FROM events GROUP BY ALL),
    a AS (SELECT s.source, lim.kind, limit_us, {FRESH_NOW} - at_us AS age_us FROM (SELECT DISTINCT user_id AS source FROM events) s CROSS JOIN lim LEFT JOIN r ON r.source = s.source AND r.kind = lim.kind)
    SELECT source, kind, age_us IS NOT NULL AS "exists", age_us, coalesce(age_us BETWEEN -30000000 AND limit_us, false) AS fresh FROM a"""


def _limits(spark):
    return spark.createDataFrame([(k, v * SECOND) for k, v in LIMITS.items()], "kind string, limit_us long")


@query(FRESH)
def receipt_fresh(spark, d):
    """Each source's last receipt of each kind against the age that this kind may have."""
    r = _events(spark, d).select(F.col("user_id").alias("source"), F.col("event_type").alias("kind"), F.col("us").alias("at_us"))
    return G.freshness(r, _limits(spark), FRESH_NOW, ["source"])


QUALITY = """WITH m AS (SELECT o_custkey AS reader, CASE WHEN o_custkey % 17 = 0 THEN 3 ELSE 0 END AS reader_exit, max(epoch_us(o_orderdate)) AS checked_us, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey % 50 * 60 END AS age_min, max(epoch_us(o_orderdate)) FILTER (o_orderstatus <> 'F') - (o_custkey % 30) * 3600000000 AS ledger_us,
      max(epoch_us(o_orderdate)) + (o_custkey % 3) * 600000000 AS now_us FROM orders GROUP BY o_custkey),
    a AS (SELECT *, (now_us - (checked_us - age_min * 60000000)) / 60000000 AS source_age_min, (ledger_us - (checked_us - age_min * 60000000)) / 60000000 AS behind_min FROM m)
    SELECT reader, CASE WHEN reader_exit <> 0 THEN 'reader_failed' WHEN source_age_min IS NULL THEN 'source_timestamp_unavailable' WHEN source_age_min > 2160 THEN 'source_stale' WHEN behind_min > 5 THEN 'source_behind_retained_ledger' WHEN ledger_us IS NULL THEN 'no_retained_events' ELSE 'source_current_relative_to_ledger' END AS status,
      CAST(floor(source_age_min) AS BIGINT) AS source_age_min, CAST(floor(behind_min) AS BIGINT) AS behind_min FROM a"""


@query(QUALITY)
def phone_quality_status(spark, d):
    i, at = F.col("o_custkey"), V.micros("o_orderdate")
    m = V.table(spark, d, "orders").groupBy(i.alias("o_custkey")).agg(F.max(at).alias("checked_us"), F.max(F.when(F.col("o_orderstatus") != "F", at)).alias("open_us"))
    m = m.select(i.alias("reader"), F.when(i % 17 == 0, 3).otherwise(0).alias("reader_exit"), "checked_us", F.when(i % 11 != 0, i % 50 * 60).alias("age_min"), (F.col("open_us") - (i % 30) * HOUR).alias("ledger_us"), (F.col("checked_us") + (i % 3) * 600 * SECOND).alias("now_us"))
    return G.source_quality(m).select("reader", "status", F.floor("source_age_min").alias("source_age_min"), F.floor("behind_min").alias("behind_min"))


HEALTH = f"""WITH x AS (SELECT event_id AS id, user_id % 4 AS device, epoch_us(ts) AS start_us, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CASE WHEN {K} % 100 < 76 + (user_id % 4) * 3 THEN 'unattributed' ELSE 'active' END WHEN event_type = 'signup' THEN 'idle' ELSE 'locked' END AS state FROM events),
    r AS (SELECT *, sum(CASE WHEN state IN ('active', 'unattributed') THEN 1 ELSE 0 END) OVER w AS windows, sum(CASE WHEN state = 'unattributed' THEN 1 ELSE 0 END) OVER w AS untitled FROM x WINDOW w AS (PARTITION BY device ORDER BY start_us, id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    h AS (SELECT *, CASE WHEN windows > 0 AND device = 3 THEN 'permission_blocked' WHEN untitled >= 60 OR (windows >= 24 AND untitled * 100 >= windows * 80) THEN 'needs_review' WHEN device = 2 THEN 'permission_limited' ELSE 'normal' END AS status FROM r)"""


def _health(spark, d):
    k, t = F.col("k"), F.col("event_type")
    window = F.when(k % 100 < 76 + F.col("device") * 3, "unattributed").otherwise("active")
    state = F.when(t.isin("view", "click", "purchase"), window).when(t == "signup", "idle").otherwise("locked")
    s = _events(spark, d).select(F.col("event_id").alias("id"), "device", F.col("us").alias("start_us"), state.alias("state"), (F.col("device") != 3).alias("screen_access"), (F.col("device") != 2).alias("ax_access"))
    return W.identity_health(s)


@query(HEALTH + " SELECT id, device, CAST(windows AS BIGINT) AS windows, CAST(untitled AS BIGINT) AS untitled, status FROM h")
def window_identity_health(spark, d):
    """Rolling share of untitled windows among a device's last 60 samples, and what it tells."""
    return _health(spark, d).select("id", "device", "windows", "untitled", "status")


@query(HEALTH + " SELECT device, start_us // 86400000000 AS day, status, count(*) AS samples FROM h GROUP BY ALL")
def identity_status(spark, d):
    return _health(spark, d).groupBy("device", F.floor(F.col("start_us") / DAY).alias("day"), "status").agg(F.count(F.lit(1)).alias("samples"))


@query(f"WITH {V.FRAMES} SELECT id, substr(sha256(concat_ws('|', app, display)), 1, 20) AS window_id, substr(sha256(id::VARCHAR), 1, 20) AS frame_id, 'screen-' || substr(sha256(id::VARCHAR), 1, 20) AS evidence_id, substr(sha256(concat_ws('|', device, at_us // 900000000)), 1, 20) AS slot_id, sha256(coalesce(app, '') || '|' || coalesce(display, '')) AS metadata_id FROM frames")
def ids(spark, d):
    """Stable ids out of content: of a frame's window, itself, its evidence, its review slot and its metadata."""
    short = lambda x: F.substr(F.sha2(x, 256), F.lit(1), F.lit(20))
    one = short(F.col("id").cast("string"))
    slot = F.concat_ws("|", F.col("device").cast("string"), F.floor(F.col("at_us") / (15 * MINUTE)).cast("string"))
    meta = F.sha2(F.concat(F.coalesce("app", F.lit("")), F.lit("|"), F.coalesce("display", F.lit(""))), 256)
    return V.frames(spark, d).select("id", short(F.concat_ws("|", "app", "display")).alias("window_id"), one.alias("frame_id"), F.concat(F.lit("screen-"), one).alias("evidence_id"), short(slot).alias("slot_id"), meta.alias("metadata_id"))


@query(f"WITH b AS (SELECT DISTINCT epoch_us(o_orderdate) // 86400000000 AS day, epoch_us(timezone('{ZONE}', date_trunc('day', o_orderdate))) AS low_us, epoch_us(timezone('{ZONE}', date_trunc('day', o_orderdate) + INTERVAL 1 DAY)) AS high_us FROM orders) SELECT day, low_us, high_us, (high_us - low_us) // 3600000000 AS hours FROM b")
def local_bounds(spark, d):
    """Bounds in UTC of local days in a zone with clock changes: 23, 24 or 25 hours."""
    low, high = _local_bounds(F.col("date"), ZONE)
    days = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select(F.unix_date("date").cast("long").alias("day"), low.alias("low_us"), high.alias("high_us")).withColumn("hours", F.floor((F.col("high_us") - F.col("low_us")) / HOUR))


MOMENT = "epoch_us(o_orderdate) + (o_orderkey % 48) * 1800000000 + o_orderkey % 1000"


@query(
    f"""WITH t AS (SELECT o_orderkey AS id, {MOMENT} AS us FROM orders), l AS (SELECT id, us, timezone('{ZONE}', timezone('UTC', make_timestamp(us))) AS local FROM t)
    SELECT id, CAST(date_part('hour', local) AS BIGINT) AS local_hour, CAST(date_part('minute', local) // 30 AS BIGINT) AS half_hour, CAST((epoch_us(local) - us) // 60000000 AS BIGINT) AS offset_min, epoch_us(date_trunc('day', local)) // 86400000000 AS local_day FROM l"""
)
def temporal_key(spark, d):
    """Local day, hour, half hour and offset of moments in a zone with clock changes: a repeated hour has two keys."""
    i = F.col("o_orderkey")
    e = V.table(spark, d, "orders").select(i.alias("id"), (V.micros("o_orderdate") + (i % 48) * 30 * MINUTE + i % 1000).alias("us"))
    return _temporal_key(e, "us", ZONE).select("id", "local_hour", "half_hour", "offset_min", F.unix_date("local_date").cast("long").alias("local_day"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents")
def normalize(spark, d):
    """Texts of Latin letters, whose compatibility form is the canonical one."""
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.coalesce("text", F.lit("")))).alias("digest"))


LEDGER_NOW = V.EPOCH_2024 + 28 * DAY


@query(
    f"""WITH {V.SAMPLES}, c AS (SELECT device, count(*) FILTER (start_us > {LEDGER_NOW} + 300000000) AS future, count(*) FILTER (dur_us <= 0 OR dur_us > 3600000000) AS invalid FROM samples GROUP BY device)
    SELECT device, 'future' AS "check", future AS rows FROM c UNION ALL SELECT device, 'invalid', invalid FROM c
    UNION ALL SELECT doc_id % 4, 'orphan_tags', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) GROUP BY ALL
    UNION ALL SELECT vec_id % 4, 'orphan_features', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) GROUP BY ALL"""
)
def ledger_integrity(spark, d):
    """Future starts, invalid durations, and tags and features whose frame is gone."""
    frames = V.frames(spark, d).where("id % 5 <> 0").select("id")
    own = lambda df: df.select("id", (F.col("id") % 4).alias("device"))
    return G.integrity(V.samples(spark, d), {"orphan_tags": (own(V.tags(spark, d)), frames), "orphan_features": (own(V.vectors(spark, d)), frames)}, LEDGER_NOW, HOUR)


SUSPECTS = f"""WITH {V.RUNS}, tf AS (SELECT event_id AS id, user_id % 4 AS device, epoch_us(ts) + 3000000 + ({K} % 3) * 7000000 AS at_us, 'app' || (event_id % 2)::VARCHAR AS app, 'w' || (({K} // 2) % 2)::VARCHAR AS win FROM events WHERE event_type IN ('view', 'error')),
    tj AS (SELECT tf.*, r.start_us AS match_us, r.app AS s_app, r.win AS s_win FROM tf ASOF LEFT JOIN (SELECT * FROM runs WHERE state IN ('active', 'unattributed')) r ON tf.device = r.device AND tf.at_us >= r.start_us),
    ts AS (SELECT *, coalesce(at_us - match_us BETWEEN 0 AND 15000000 AND s_app <> app AND s_win = win, false) AS suspect FROM tj)"""


def _suspects(spark, d):
    k = F.col("k")
    f = _events(spark, d).where(F.col("event_type").isin("view", "error"))
    f = f.select(F.col("event_id").alias("id"), "device", (F.col("us") + 3 * SECOND + (k % 3) * 7 * SECOND).alias("at_us"), F.concat(F.lit("app"), (F.col("event_id") % 2).cast("string")).alias("app"), F.concat(F.lit("w"), (F.floor(k / 2) % 2).cast("string")).alias("win"))
    runs = _runs(spark, d).where("state IN ('active', 'unattributed')").withColumnsRenamed({"app": "s_app", "win": "s_win"})
    return asof(f, runs, ["device"], "at_us", ["s_app", "s_win"]).withColumn("suspect", G.title_suspects(f))


@query(SUSPECTS + " SELECT device, at_us // 86400000000 AS day, count(*) AS frames, count(*) FILTER (suspect) AS suspects FROM ts GROUP BY ALL")
def asof_audit(spark, d):
    """Frames by day, and those with the last sample's title under another app."""
    return _suspects(spark, d).groupBy("device", F.floor(F.col("at_us") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("frames"), F.count_if("suspect").alias("suspects"))


@query(SUSPECTS + " SELECT id, device, app, s_app, win, at_us - match_us AS lag_us FROM ts WHERE suspect")
def title_backfill_suspects(spark, d):
    return _suspects(spark, d).where("suspect").select("id", "device", "app", "s_app", "win", (F.col("at_us") - F.col("match_us")).alias("lag_us"))
