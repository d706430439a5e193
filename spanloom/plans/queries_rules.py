"""Rules of the core in full: sources, hosts, block contents, boundaries, scores of a day, logs, retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.time import DAY, MINUTE, SECOND
from spanloom.operators import activity as A
from spanloom.operators import review as W
from spanloom.operators import rollup as R
from spanloom.operators import trial as E
from spanloom.operators.interval import cut
from spanloom.plans.book import Book
from spanloom.plans.queries_activity import BLOCK_PARTS, FOLD, _runs, _segs
from spanloom.sources import adapters as V
from spanloom.sources import ingest as S

def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql


@query(
    """WITH s AS (SELECT event_id AS id, user_id % 4 AS device, epoch_us(ts) AS start_us, CAST(round(value * 20e6) AS BIGINT) AS dur_us, CASE event_type WHEN 'view' THEN 'mac_window_sample' WHEN 'click' THEN 'mac_window_legacy' WHEN 'purchase' THEN 'mac_idle' WHEN 'signup' THEN 'mac_idle_legacy' ELSE 'browser_tab' END AS source FROM events)
    SELECT id, device, source, start_us, dur_us FROM s WHERE source <> 'browser_tab' AND dur_us > 0 AND dur_us <= CASE WHEN ends_with(source, '_legacy') THEN 21600000000 ELSE 30000000 END"""
)
def valid_sources(spark, d):
    """Samples of known sources, with the bound that each has."""
    t = F.col("event_type")
    names = {"view": "mac_window_sample", "click": "mac_window_legacy", "purchase": "mac_idle", "signup": "mac_idle_legacy"}
    source = F.lit("browser_tab")
    for kind, name in names.items():
        source = F.when(t == kind, name).otherwise(source)
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("device"), source.alias("source"), V.micros("ts").alias("start_us"), F.round(F.col("value") * 20e6).cast("long").alias("dur_us"))
    return A.valid_sources(e)


@query(
    f"""WITH {V.SEGMENTS}, tb AS (SELECT event_id AS id, user_id % 4 AS device, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) AS start_us, 'h' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7)::VARCHAR AS site, event_type = 'view' AS focused FROM events WHERE event_type IN ('view', 'error')),
    l AS (SELECT *, coalesce(lead(start_us) OVER (PARTITION BY device, day ORDER BY start_us, id), (day + 1) * 86400000000) AS end_us FROM tb)
    SELECT l.device, site, CAST(round(sum((least(l.end_us, s.end_us) - greatest(l.start_us, s.start_us))::DOUBLE * s.sampled_us / (s.end_us - s.start_us)) / 1000) AS BIGINT) AS ms FROM l JOIN segments s ON s.device = l.device AND s.day = l.day AND s.state IN ('active', 'unattributed') AND s.app = 'app1' AND s.start_us < l.end_us AND l.start_us < s.end_us
    WHERE focused AND l.end_us > l.start_us GROUP BY l.device, site"""
)
def browser_shares(spark, d):
    """Tab time scaled by what was sampled of the segments that it meets."""
    return A.browser_shares(V.tabs(spark, d), _segs(spark, d), "app1").select("device", "site", F.round(F.col("us") / 1000).cast("long").alias("ms"))


HOSTED = f"""{V.RUNS}, hr AS (SELECT *, CASE WHEN state = 'active' AND k % 5 <> 0 THEN 'h' || (k % 3)::VARCHAR END AS host, CASE WHEN k % 4 = 0 THEN 'legacy' ELSE 'exact' END AS evidence FROM runs),
    hm AS (SELECT *, CASE WHEN {' AND '.join(f'lag({c}) OVER w IS NOT DISTINCT FROM {c}' for c in ('state', 'evidence', 'app', 'win', 'host'))} AND start_us - lag(end_us) OVER w BETWEEN 0 AND 2000000 THEN 0 ELSE 1 END AS new FROM hr WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
    hn AS (SELECT *, sum(new) OVER (PARTITION BY device, day ORDER BY start_us) AS island FROM hm)"""


@query(f"WITH {HOSTED} SELECT device, day, min(start_us) AS start_us, max(end_us) AS end_us, any_value(state) AS state, any_value(evidence) AS evidence, any_value(app) AS app, any_value(win) AS win, any_value(host) AS host, count(*) AS samples, CAST(sum(end_us - start_us) AS BIGINT) AS sampled_us FROM hn GROUP BY device, day, island")
def host_segments(spark, d):
    """Segments that a change of site or of evidence ends as well."""
    k = F.col("k")
    runs = _runs(spark, d).withColumns({"host": F.when((F.col("state") == "active") & (k % 5 != 0), F.concat(F.lit("h"), (k % 3).cast("string"))), "evidence": F.when(k % 4 == 0, "legacy").otherwise("exact")})
    return A.segments(runs, same=("state", "evidence", "app", "win", "host")).drop("island")


@query(
    FOLD.format(
        base=BLOCK_PARTS.replace("numbered_parts AS (SELECT *,", "numbered_parts AS (SELECT *, start_us AS seg_start,"),
        carry="app, win, sampled_us, seg_start",
        pick="f.app AS app, " + ", ".join(f"CASE WHEN f.block_end < f.seg_end THEN f.{c} ELSE n.{c} END AS {c}" for c in ("win", "sampled_us", "seg_start")),
    )
    + """, t AS (SELECT device, day, part, block, CASE WHEN win = 'w1' THEN '[sensitive window]' ELSE win END AS title, sum(sampled_us::DOUBLE * (block_end - pos) / (seg_end - seg_start)) AS us, min(pos) AS seen FROM f WHERE win IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY device, day, part, block ORDER BY us DESC, seen) AS rank, count(*) OVER (PARTITION BY device, day, part, block) AS windows, min(seen) OVER (PARTITION BY device, day, part, block) AS start_us FROM t)
    SELECT device, day, start_us, title, CAST(round(us / 1000) AS BIGINT) AS ms, rank, windows FROM r WHERE rank <= 5"""
)
def focus_block_windows(spark, d):
    """The five titles with most time in each focus block; some titles are sensitive."""
    segs = _segs(spark, d).withColumn("win", F.when(F.col("win") == "w1", "my bank account").otherwise(F.col("win")))
    return A.block_windows(segs).select("device", "day", "start_us", "title", F.round(F.col("us") / 1000).cast("long").alias("ms"), "rank", "windows")


BOUNDED = f"""{V.RUNS}, bd AS (SELECT DISTINCT device, start_us AS at_us FROM samples WHERE k % 23 = 0),
    rb AS (SELECT r.device, r.day, r.id, r.state, r.app, r.win, r.start_us, r.end_us, r.id % 17 = 0 AS barrier, list_sort(list(b.at_us) FILTER (b.at_us IS NOT NULL)) AS cuts FROM runs r LEFT JOIN bd b ON b.device = r.device AND b.at_us > r.start_us AND b.at_us < r.end_us GROUP BY ALL),
    ce AS (SELECT *, list_concat([start_us], coalesce(cuts, []::BIGINT[]), [end_us]) AS e FROM rb), pc AS (SELECT device, day, id, state, app, win, barrier, e[i] AS start_us, e[i + 1] AS end_us FROM (SELECT *, unnest(range(1, len(e))) AS i FROM ce)),
    am AS (SELECT pc.*, m.at_us AS match_us FROM pc ASOF LEFT JOIN bd m ON pc.device = m.device AND pc.start_us >= m.at_us),
    mk AS (SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state AND lag(app) OVER w IS NOT DISTINCT FROM app AND lag(win) OVER w IS NOT DISTINCT FROM win AND start_us - lag(end_us) OVER w BETWEEN 0 AND 2000000 AND NOT coalesce(match_us >= lag(end_us) OVER w, false) AND NOT barrier AND NOT coalesce(lag(barrier) OVER w, false) THEN 0 ELSE 1 END AS new FROM am WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
    pt AS (SELECT *, sum(new) OVER (PARTITION BY device, day ORDER BY start_us) AS part FROM mk), numbered_parts AS (SELECT *, row_number() OVER (PARTITION BY device, day, part ORDER BY start_us) AS r FROM pt)"""


@query(
    FOLD.format(base=BOUNDED, carry="state, app, win", pick="f.state AS state, f.app AS app, f.win AS win")
    + """, g AS (SELECT device, day, min(pos) AS start_us, max(block_end) AS end_us, CAST(sum(block_end - pos) AS BIGINT) AS us, any_value(state) AS state, any_value(app) AS app, any_value(win) AS win, string_agg(pos::VARCHAR || '-' || block_end::VARCHAR, ',' ORDER BY pos) AS spans FROM f GROUP BY device, day, part, block)
    SELECT device, day, start_us, end_us, us, state, app, win, 'episode-' || sha256(device::VARCHAR || '|' || state || '|' || coalesce(app, '') || '|' || coalesce(win, '') || '|' || spans) AS episode_id FROM g"""
)
def bounded_episodes(spark, d):
    """Episodes with explicit boundaries, barriers and ids by content."""
    marks = V.samples(spark, d).where("k % 23 = 0").select("device", F.col("start_us").alias("at_us"))
    return A.bounded_episodes(_runs(spark, d).withColumn("barrier", F.col("id") % 17 == 0), marks)


NOW = V.EPOCH_2024 + 20 * DAY


@query(
    f"""WITH {V.SESSIONS}, {V.RUNS[len(V.SAMPLES) + 2:]}, {V.FRAMES},
    c AS (SELECT device, state, slot, CASE WHEN k % 5 <> 0 AND state = 'active' THEN 'topic' || (k % 3)::VARCHAR END AS topic, greatest(start_us, slot * 300000000) AS s, least(end_us, (slot + 1) * 300000000) AS e FROM (SELECT *, unnest(range(start_us // 300000000, (end_us - 1) // 300000000 + 1)) AS slot FROM runs)),
    sp AS (SELECT device, day, unnest(range(day * 288, (day + 1) * 288)) AS slot FROM (SELECT DISTINCT device, day FROM runs)),
    st AS (SELECT device, slot, {', '.join(f"CAST(sum(CASE WHEN state = '{x}' THEN e - s ELSE 0 END) AS BIGINT) AS {x}_us" for x in A.PRECEDENCE)} FROM c GROUP BY ALL),
    tp AS (SELECT device, slot, topic FROM (SELECT device, slot, topic, sum(e - s) AS us, min(s) AS seen FROM c WHERE topic IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY device, slot ORDER BY us DESC, seen, topic) = 1),
    pc AS (SELECT device, app, slot, greatest(start_us, slot * 300000000) AS s, least(end_us, (slot + 1) * 300000000) AS e FROM (SELECT *, unnest(range(start_us // 300000000, (end_us - 1) // 300000000 + 1)) AS slot FROM sessions)),
    pu AS (SELECT device, slot, CAST(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS BIGINT) AS phone_us FROM (SELECT *, max(e) OVER (PARTITION BY device, slot ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pc) GROUP BY ALL),
    pa AS (SELECT device, slot, app AS phone_app FROM (SELECT device, slot, app, sum(e - s) AS us, min(s) AS seen FROM pc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY device, slot ORDER BY us DESC, seen, app) = 1),
    sc AS (SELECT device, slot, topic AS screen FROM (SELECT device, at_us // 300000000 AS slot, app AS topic, count(*) AS n, min(at_us) AS seen FROM frames GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY device, slot ORDER BY n DESC, seen, topic) = 1)
    SELECT sp.device, sp.day, sp.slot, CASE WHEN sp.slot * 300000000 >= {NOW} THEN 'future' WHEN active_us > 0 THEN 'active' WHEN unattributed_us > 0 THEN 'unattributed' WHEN locked_us > 0 THEN 'locked' WHEN idle_us > 0 THEN 'idle' ELSE 'unknown' END AS state, coalesce(active_us, 0) AS active_us, coalesce(unattributed_us, 0) AS unattributed_us, topic,
      CASE WHEN unattributed_us > 0 THEN screen END AS screen_topic, coalesce(phone_us, 0) AS phone_us, phone_app FROM sp LEFT JOIN st USING (device, slot) LEFT JOIN tp USING (device, slot) LEFT JOIN pu USING (device, slot) LEFT JOIN pa USING (device, slot) LEFT JOIN sc USING (device, slot)"""
)
def activity_score(spark, d):
    """Five-minute bins of whole days with topic, screen and phone; bins after now are future."""
    k = F.col("k")
    runs = _runs(spark, d).withColumn("topic", F.when((k % 5 != 0) & (F.col("state") == "active"), F.concat(F.lit("topic"), (k % 3).cast("string"))))
    screens = V.frames(spark, d).select("device", "at_us", F.col("app").alias("topic"))
    return A.activity_score(runs, V.sessions(spark, d), screens, NOW)


@query(
    """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS id, (k % 50) / 1000.0::DOUBLE AS load_s, 12.5::DOUBLE / 1000 AS prompt_s, CASE WHEN k % 3 = 0 THEN 40 END AS prompt_tokens, (k % 900) / 1000.0::DOUBLE AS generation_s, k % 70 AS generated_tokens, CASE WHEN k % 2 = 0 THEN (k % 90) / 1000.0::DOUBLE END AS encode_s,
    CASE WHEN k % 900 > 0 THEN CAST(floor((k % 70) / ((k % 900) / 1000.0::DOUBLE) + 0.5) AS BIGINT) END AS rate FROM o"""
)
def engine_report(spark, d):
    """Timings of logs that have some lines twice: the last counts."""
    k = F.col("k")
    part = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    log = F.concat(
        part("x: load time = ", k % 50, " ms\nx: prompt eval time = 12.5 ms"), F.when(k % 3 == 0, " / 40 tokens").otherwise(""), F.lit("\nx: eval time = 99.0 ms / 5 runs\n"),
        F.when(k % 2 == 0, part("image encoded in ", k % 90, " ms\n")).otherwise(""), part("x: eval time = ", k % 900, " ms / ", k % 70, " runs\n"),
    )
    t = T.engine_report(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("id"), log.alias("log")), "log")
    return t.select("id", "load_s", "prompt_s", "prompt_tokens", "generation_s", "generated_tokens", "encode_s", F.floor(F.col("tokens_per_s") + 0.5).alias("rate"))


TRIED = f"""WITH {V.ANNOTATIONS}, fb AS (SELECT path, CASE arg_max(status, n) WHEN 'filtered' THEN 'sensitive_skipped' ELSE arg_max(status, n) END AS fallback, count(*) AS attempts FROM annotations WHERE n > 1 GROUP BY path),
    ca AS (SELECT a.path, fallback, coalesce(attempts, 0) AS attempts, a.status FROM annotations a LEFT JOIN fb USING (path) WHERE a.n = 1 AND a.path % 5 <> 0 AND (fallback IS NULL OR (fallback NOT IN ('complete', 'sensitive_skipped') AND attempts < 2)))"""


def _tried(spark, d):
    a = V.annotations(spark, d)
    last = F.max_by("status", "n")
    fallback = a.where("n > 1").groupBy("path").agg(F.when(last == "filtered", "sensitive_skipped").otherwise(last).alias("status"), F.count(F.lit(1)).alias("attempts"))
    return a.where("n = 1"), fallback, a.where("path % 5 <> 0").select("path").distinct()


@query(TRIED + " SELECT path, fallback, attempts FROM ca WHERE status = 'incomplete'")
def incomplete_candidates(spark, d):
    return W.fallback_candidates(*_tried(spark, d), "incomplete")


@query(TRIED + " SELECT path, fallback, attempts FROM ca WHERE status = 'complete'")
def quality_candidates(spark, d):
    return W.fallback_candidates(*_tried(spark, d), "complete")


@query(f"WITH {V.ANNOTATIONS}, p AS (SELECT *, n % 3 AS prompt, n AS attempts FROM annotations) SELECT path, model, prompt, status, attempts, elapsed_s FROM p QUALIFY row_number() OVER (PARTITION BY path, model, prompt ORDER BY at_us DESC, n DESC) = 1")
def upsert_descriptions(spark, d):
    """Descriptions by path, model and prompt; a later row sets what it has."""
    a = V.annotations(spark, d).withColumns({"prompt": F.col("n") % 3, "attempts": F.col("n")})
    return S.upsert_descriptions(a.where("n <= 3"), a.where("n > 3")).select("path", "model", "prompt", "status", "attempts", "elapsed_s")


SLOTS = f"""{V.RUNS}, un AS (SELECT device, start_us, end_us FROM runs WHERE state = 'unattributed'),
    rs AS (SELECT device, slot, CAST(sum(least(end_us, (slot + 1) * 900000000) - greatest(start_us, slot * 900000000)) AS BIGINT) AS unknown_us FROM (SELECT *, unnest(range(start_us // 900000000, (end_us - 1) // 900000000 + 1)) AS slot FROM un) GROUP BY device, slot HAVING sum(least(end_us, (slot + 1) * 900000000) - greatest(start_us, slot * 900000000)) >= 120000000),
    so AS (SELECT device, slot, 'l' || (slot % 4)::VARCHAR AS label, slot * 900000000 AS start_us, slot * 900000000 + CASE WHEN slot % 2 = 0 THEN 900000000 ELSE 300000000 END AS end_us FROM rs WHERE slot % 3 = 0),
    co AS (SELECT so.device, so.slot, CAST(sum(least(so.end_us, un.end_us) - greatest(so.start_us, un.start_us)) AS BIGINT) AS covered_us FROM so JOIN un ON un.device = so.device AND un.start_us < so.end_us AND so.start_us < un.end_us GROUP BY ALL),
    su AS (SELECT device, slot, topic FROM (SELECT device, start_us // 900000000 AS slot, 'h' || (k % 3)::VARCHAR AS topic, count(*) AS n, min(start_us) AS seen FROM samples WHERE k % 10 IN (1, 2) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY device, slot ORDER BY n DESC, seen, topic) = 1),
    vw AS (SELECT rs.device, rs.slot, unknown_us, label AS scope_label, least(coalesce(covered_us, 0), unknown_us) AS confirmed_us, topic AS suggested_label, rs.slot % 6 = 0 AS outcome_marked FROM rs LEFT JOIN so USING (device, slot) LEFT JOIN co USING (device, slot) LEFT JOIN su USING (device, slot))"""


@query(f"WITH {SLOTS} SELECT device, slot, unknown_us, CASE WHEN confirmed_us >= unknown_us THEN scope_label END AS confirmed_label, scope_label, confirmed_us, unknown_us - confirmed_us AS unconfirmed_us, suggested_label, outcome_marked FROM vw")
def review_slots_view(spark, d):
    """Slots to review with scope, cover, suggestion and outcome."""
    step = 15 * MINUTE
    unknown = _runs(spark, d).where("state = 'unattributed'").select("device", "start_us", "end_us")
    slots = cut(unknown, step).groupBy("device", "slot").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("unknown_us")).where(F.col("unknown_us") >= 120 * SECOND)
    start = F.col("slot") * step
    scopes = slots.where("slot % 3 = 0").select("device", "slot", F.concat(F.lit("l"), (F.col("slot") % 4).cast("string")).alias("label"), start.alias("start_us"), (start + F.when(F.col("slot") % 2 == 0, step).otherwise(step // 3)).alias("end_us"))
    topics = V.samples(spark, d).where("k % 10 IN (1, 2)").select("device", F.col("start_us").alias("at_us"), F.concat(F.lit("h"), (F.col("k") % 3).cast("string")).alias("topic"))
    return W.review_view(slots, unknown, scopes, slots.where("slot % 6 = 0"), topics, step)


@query(f"WITH {V.SEGMENTS}, t AS (SELECT device, day, app, CASE WHEN win = 'w1' THEN '[sensitive window]' ELSE win END AS title, CAST(sum(sampled_us) AS BIGINT) AS us, min(start_us) AS seen FROM segments WHERE state = 'active' GROUP BY ALL) SELECT device, day, app, title, us, row_number() OVER (PARTITION BY device, day ORDER BY us DESC, seen) AS rank FROM t QUALIFY rank <= 3")
def day_windows(spark, d):
    """Titles with most time in each day, sensitive ones as one."""
    return A.day_windows(_segs(spark, d).withColumn("win", F.when(F.col("win") == "w1", "password list").otherwise(F.col("win"))), 3)


RATES = f"""{V.SEGMENTS}, fm AS (SELECT device, day, sampled_us, CASE WHEN row_number() OVER w > 1 AND lag(app) OVER w IS DISTINCT FROM app THEN 1 ELSE 0 END AS a, CASE WHEN row_number() OVER w > 1 AND lag(win) OVER w IS DISTINCT FROM win THEN 1 ELSE 0 END AS w FROM segments WHERE state = 'active' WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
    rates AS (SELECT device, day, CAST(sum(greatest(a, w)) AS BIGINT) AS window_switches, CAST(sum(a) AS BIGINT) AS app_switches, CAST(sum(sampled_us) AS BIGINT) AS us FROM fm GROUP BY device, day)"""


@query(f"WITH {RATES} SELECT *, CASE WHEN us > 0 THEN CAST(window_switches * 1000 * 3600000000 // us AS BIGINT) END AS switches_per_hour_x1000 FROM rates")
def switch_rates(spark, d):
    """Window and app switches by day, and their rate an hour of sampled time."""
    return A.switch_rates(_segs(spark, d))


@query(f"WITH {RATES} SELECT device, count(*) AS days, CAST(sum(window_switches) AS BIGINT) AS window_switches, CAST(sum(app_switches) AS BIGINT) AS app_switches, CAST(sum(us) AS BIGINT) AS us, CASE WHEN sum(us) > 0 THEN CAST(sum(window_switches)::HUGEINT * 1000 * 3600000000 // sum(us) AS BIGINT) END AS switches_per_hour_x1000 FROM rates GROUP BY device")
def switch_rates_of_periods(spark, d):
    return A.switch_rates_of_periods(A.switch_rates(_segs(spark, d)))


@query(f"WITH {V.ANNOTATIONS}, t AS (SELECT model, at_us // 86400000000 AS day, path, n FROM annotations) SELECT model, year(DATE '1970-01-01' + CAST(day AS INTEGER)) AS year, count(DISTINCT path) AS paths, true AS near, true AS median_near FROM t GROUP BY ALL")
def period_sketches(spark, d):
    """Distinct paths of a year exactly, and whether the merged day sketches come within five per cent of them and of the
    median path number's rank."""
    a = V.annotations(spark, d).withColumn("day", F.floor(F.col("at_us") / DAY))
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))).cast("long")
    days = R.day_sketches(a, ["model", "day"], "path", "path").withColumn("year", year)
    told = R.period_sketches(days, ["model", "year"]).join(a.groupBy("model", year.alias("year")).agg(F.count_distinct("path").alias("paths")), ["model", "year"])
    rank = a.withColumn("year", year).join(told.select("model", "year", "median"), ["model", "year"]).groupBy("model", "year").agg(F.avg((F.col("path") <= F.col("median")).cast("double")).alias("below"))
    near = F.abs(F.col("distinct_items") - F.col("paths")) <= F.greatest(F.lit(1), F.col("paths") * 0.05)
    return told.join(rank, ["model", "year"]).select("model", "year", "paths", near.alias("near"), F.col("below").between(0.45, 0.55).alias("median_near"))


@query(f"WITH {V.RUNS} SELECT id, device, day, state, start_us, end_us FROM runs WHERE day = 19726")
def ledger_day(spark, d):
    """One day's runs out of a ledger laid out by day, source and device: two day folders are read, and nothing is dealt
    before the first window."""
    from spanloom.sources import book_of_days as B
    from spanloom.sources.scratch import scratch

    path = scratch(spark)
    name = "ledger_" + path.rsplit("-", 1)[-1]
    B.store(V.samples(spark, d).withColumn("source", F.col("state")), name, path, 8)
    low = 19_726 * DAY
    rows = B.read_days(spark, name, low, low + DAY)
    return A.observed_runs(rows).where("day = 19726").select("id", "device", "day", "state", "start_us", "end_us")


def _tokens_sql(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}'), lambda w: (length(w) >= 4 OR list_contains({list(T.SHORT_SUBJECTS)}, w)) AND NOT list_contains({list(T.GENERIC)}, w)), lambda w: regexp_replace(w, 's+$', '')))"


@query(
    f"""WITH p AS (SELECT b.conv_id, b.turn, CASE WHEN b.conv_id % 9 = 0 THEN 'Unclear' ELSE left(b.text, 40) END AS topic, regexp_extract(lower(b.text), '[a-z]{{3,}}') AS word, a.text AS source FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1)
    SELECT conv_id, turn, lower(topic) = 'unclear' OR ((length(word) >= 4 OR list_contains({list(T.SHORT_SUBJECTS)}, word)) AND contains(lower(source), word) AND list_has_any({_tokens_sql('topic')}, {_tokens_sql('source')})) AS supported FROM p"""
)
def topic_support(spark, d):
    """Whether the turn before supports what a turn begins with."""
    c = V.table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    topic = F.when(F.col("conv_id") % 9 == 0, "Unclear").otherwise(F.left("text", F.lit(40)))
    word = F.regexp_extract(F.lower("text"), "[a-z]{3,}", 0)
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", T.supported_topic(topic, word, F.col("source")).alias("supported"))


IDENTIFIERS = [("idiot", "word"), ("ther ", "literal")]
FLAGS_SQL = f"""[regexp_matches(s, {_q(T.HOME_PATH)}), regexp_matches(s, '(?i)(^|[^A-Za-z0-9])idiot([^A-Za-z0-9]|$)') OR contains(s, 'ther '), regexp_matches(s, {_q(T.CREDENTIAL)}), len(list_filter(regexp_extract_all(lower(s), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'), lambda a: NOT list_contains({list(T.EXAMPLE_DOMAINS)}, split_part(a, '@', 2)) AND a <> 'noreply@github.com')) > 0]"""


@query(
    f"""WITH l AS (SELECT doc_id, replace(unnest(string_split(coalesce(text, ''), chr(10))), '\\/', '/') AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
    k AS (SELECT doc_id, n, unnest(['home_path', 'identifier', 'credential', 'contact']) AS kind, unnest({FLAGS_SQL}) AS hit FROM l) SELECT doc_id, kind, count(*) AS lines, min(n) AS first_line FROM k WHERE hit GROUP BY ALL"""
)
def privacy_scan(spark, d):
    """Lines with home paths, private identifiers, credentials or contacts that are no example."""
    return T.privacy_scan(V.table(spark, d, "documents"), "doc_id", "text", IDENTIFIERS)


@query(
    f"""WITH r AS (SELECT doc_id, replace(regexp_replace(regexp_replace(text, '(?i)(^|[^A-Za-z0-9])idiot($|[^A-Za-z0-9])', '\\1[word]\\2', 'g'), '(?i)(^|[^A-Za-z0-9])idiot($|[^A-Za-z0-9])', '\\1[word]\\2', 'g'), 'ther ', 'thing ') AS t FROM documents), f AS (SELECT doc_id, t, replace(coalesce(t, ''), '\\/', '/') AS s FROM r)
    SELECT doc_id, CASE WHEN NOT ((({FLAGS_SQL})[1]) OR (({FLAGS_SQL})[2]) OR (({FLAGS_SQL})[4])) THEN md5(t) END AS digest FROM f"""
)
def publishable_text(spark, d):
    """Texts after redaction; none where something private is left."""
    rules = [("idiot", "word", "[word]"), ("ther ", "literal", "thing ")]
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.publishable(F.col("text"), rules)).alias("digest"))


@query(
    f"""WITH {V.SCREENS}, {V.CAPTIONS}, dd AS (SELECT id, status, at_us // 86400000000 AS day FROM screens), ow AS (SELECT day, count(*) AS frames, count(*) FILTER (status = 'complete') AS read, count(*) FILTER (status IS DISTINCT FROM 'complete') AS pending FROM dd GROUP BY day),
    an AS (SELECT day, count(*) FILTER (c.status = 'complete') AS complete, count(*) FILTER (c.status = 'incomplete') AS incomplete, count(*) FILTER (c.status = 'filtered') AS filtered FROM captions c JOIN dd USING (id) GROUP BY day)
    SELECT day, frames, read, pending, coalesce(complete, 0) AS complete, coalesce(incomplete, 0) AS incomplete, coalesce(filtered, 0) AS filtered FROM ow LEFT JOIN an USING (day)"""
)
def frame_counts(spark, d):
    """Frames by day, read and pending, and their annotations by status."""
    return W.frame_counts(V.screens(spark, d), V.captions(spark, d), F.floor(F.col("at_us") / DAY))


@query(f"WITH {V.ANNOTATIONS}, m AS (SELECT model, CAST(floor(23400 * 0.8 / quantile_disc(elapsed_s, 0.9)) AS BIGINT) AS capacity FROM annotations WHERE status = 'complete' GROUP BY model) SELECT model, capacity, {', '.join(f'CAST(ceil({h * 3600}.0 / capacity) AS BIGINT) AS seconds_{h}h' for h in (8, 10, 12))} FROM m")
def frame_intervals(spark, d):
    """Least seconds between frames for active days of 8, 10 and 12 hours."""
    m = W.model_benchmark(V.annotations(spark, d).where("status = 'complete'"), 23_400, 0.8)
    return W.frame_intervals(m).select("model", "capacity", "seconds_8h", "seconds_10h", "seconds_12h")


COUNTED = {"events": "event_type", "documents": "source", "lineitem": "l_returnflag", "conversations": "role"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS ledger, {c} AS source, count(*) AS rows FROM {t} GROUP BY {c}" for t, c in COUNTED.items()))
def ledger_counts(spark, d):
    """Rows by table and source."""
    parts = [V.table(spark, d, t).groupBy(F.col(c).alias("source")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("ledger"), "source", "rows") for t, c in COUNTED.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query()
def specialization_split(spark, d):
    """Frames selected for training and held-out parts, by the survey's rules; the tests hold it against a plain version."""
    f, i = V.frames(spark, d), F.col("id")
    at = V.EPOCH_2024 + F.floor(i / 5) * 9000 * SECOND + (i % 5) * MINUTE  # five frames every two and a half hours
    f = f.withColumn("at_us", at)
    frames = f.select("id", (F.floor(i / 5) % 2).alias("device"), "at_us", F.floor(F.col("at_us") / DAY).alias("day"), "app", F.concat(F.lit("w"), (i % 2).cast("string")).alias("win"), F.xxhash64("text").alias("code"), (~T.is_sensitive(F.col("text"))).alias("ok"))
    last = frames.agg(F.max("day").alias("day")).first().day
    return E.specialization_split(frames, last + 1, {"test": 20, "validation": 20, "train": 60})
