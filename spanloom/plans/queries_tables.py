"""Queries of ledgers, annotations, artifacts, calendars, receipts, corrections and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.time import DAY, HOUR, MINUTE, SECOND
from spanloom.operators import activity as A
from spanloom.operators import quality as Q
from spanloom.operators import review as W
from spanloom.operators import rollup as R
from spanloom.plans.book import Book
from spanloom.plans.queries_activity import _runs
from spanloom.sources import adapters as V
from spanloom.sources import ingest as S

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql

DISPOSITION = f"""WITH {V.SAMPLES}, x AS (SELECT device, CASE WHEN dur_us <= 0 OR dur_us > 7200000000 OR start_us > 1706400000000000 THEN 'suspect' WHEN start_us < 1704672000000000 THEN 'old' ELSE 'keep' END AS disposition FROM samples)"""


@query(DISPOSITION + " SELECT device, disposition, count(*) AS rows FROM x GROUP BY ALL")
def import_phone_sessions(spark, d):
    told = S.disposition(V.samples(spark, d), now_us=V.EPOCH_2024 + 27 * DAY, lookback_us=20 * DAY, most_us=2 * HOUR, ahead_us=0)
    return told.groupBy("device", "disposition").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {V.COMMITS}, k AS (SELECT DISTINCT repo, sha, at_us FROM commits WHERE author = 3 OR committer = 3), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY at_us DESC, sha DESC) AS rank, count(*) OVER (PARTITION BY repo) > 60 AS truncated FROM k) SELECT repo, sha, at_us, rank, truncated FROM r WHERE rank <= 60")
def import_commits(spark, d):
    return S.import_commits(V.commits(spark, d), owner=3, cap=60)


@query(f"WITH {V.FILES} SELECT root, path, kind, at_us // 120000000 AS bucket, min(at_us) AS at_us FROM files WHERE work GROUP BY ALL")
def import_file_events(spark, d):
    return S.import_file_events(V.file_events(spark, d), 120 * SECOND)


@query(
    """WITH r AS (SELECT event_id, user_id % 4 AS device, substr(sha256(concat_ws('|', event_type, user_id, value > 50)), 1, 16) AS row_id FROM events), s AS (SELECT DISTINCT row_id FROM r WHERE event_id % 3 = 0)
    SELECT device, count(DISTINCT row_id) AS added, count(DISTINCT row_id) FILTER (starts_with(row_id, '0')) AS first_ids FROM r WHERE event_id % 3 <> 0 AND row_id NOT IN (SELECT row_id FROM s) GROUP BY device"""
)
def ingest_events(spark, d):
    """Content-addressed append: of new rows, those whose id is stored already, or that repeat, are ignored."""
    e = V.table(spark, d, "events")
    rows = S.with_id(e.withColumn("big", F.col("value") > 50), ["event_type", "user_id", "big"])
    added = S.append_new(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"))
    return added.groupBy((F.col("user_id") % 4).alias("device")).agg(F.count(F.lit(1)).alias("added"), F.count_if(F.startswith("row_id", F.lit("0"))).alias("first_ids"))


@query(f"WITH {V.ANNOTATIONS} SELECT path, model, count(*) AS attempts, arg_max(status, (n, status)) AS status FROM annotations GROUP BY ALL")
def upsert_annotations(spark, d):
    a = V.annotations(spark, d)
    old, new = a.where("n <= 3"), a.where("n > 3")
    stored = S.upsert_annotations(S.empty_annotations(spark), old)
    return S.upsert_annotations(stored, new).select("path", "model", "attempts", "status")


@query("SELECT d.doc_id AS id, d.source AS app, CASE WHEN l.doc_id IS NOT NULL THEN 'late' ELSE 'first' END AS status, coalesce(CASE WHEN d.doc_id % 3 <> 0 THEN d.lang END, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality::VARCHAR END) AS win FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def upsert_frames(spark, d):
    """Late rows fill nulls, never overwrite what was observed; status is replaced."""
    first = V.frames(spark, d).select("id", "app", F.when(F.col("id") % 3 != 0, F.col("display")).alias("win"), F.lit("first").alias("status"))
    late = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("app"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("win"), F.lit("late").alias("status"))
    return S.fill_in(first, late, "id", keep=["app", "win"], replace=["status"]).select("id", "app", "status", "win")


@query(f"WITH {V.FILES} SELECT root, count(*) AS events, count(*) FILTER (work) AS work_events, count(DISTINCT path) FILTER (work) AS work_files FROM files GROUP BY root")
def work_artifacts(spark, d):
    return R.work_artifacts(V.commits(spark, d), V.file_events(spark, d))[1]


@query(f"WITH {V.COMMITS} SELECT repo, count(*) AS commits FROM commits GROUP BY repo ORDER BY commits DESC, repo LIMIT 8")
def commits_by_repo(spark, d):
    return R.work_artifacts(V.commits(spark, d), V.file_events(spark, d))[0]


@query(f"WITH {V.FILES} SELECT path, work FROM files GROUP BY ALL")
def is_work_path(spark, d):
    from spanloom.functions.text import is_work_path as rule

    return V.file_events(spark, d).select("path", rule(F.col("path")).alias("work")).distinct()


@query(
    f"""WITH {V.CALENDAR}, t AS (SELECT * FROM calendar WHERE NOT all_day AND end_us > start_us AND end_us - start_us < 86400000000),
    p AS (SELECT id, day, greatest(start_us, day * 86400000000) AS start_us, least(end_us, (day + 1) * 86400000000) AS end_us FROM (SELECT *, unnest(range(start_us // 86400000000, (end_us - 1) // 86400000000 + 1)) AS day FROM t)),
    m AS (SELECT *, max(end_us) OVER (PARTITION BY day ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p)
    SELECT day, CAST(sum(greatest(0, end_us - greatest(start_us, coalesce(reach, start_us)))) AS BIGINT) AS union_us, count(DISTINCT id) AS events FROM m GROUP BY day"""
)
def calendar_summary(spark, d):
    return R.calendar_summary(V.calendar(spark, d))


@query(f"WITH {V.CALENDAR} SELECT day, count(*) AS items FROM (SELECT unnest(range(start_us // 86400000000, (end_us - 1) // 86400000000 + 1)) AS day FROM calendar WHERE end_us > start_us) GROUP BY day")
def scope_overlap_calendar(spark, d):
    from spanloom.operators.interval import by_day

    return by_day(V.calendar(spark, d)).groupBy("day").agg(F.count(F.lit(1)).alias("items"))


@query(f"WITH {V.ANNOTATIONS} SELECT model, status, count(*) AS rows, count(DISTINCT path) AS frames FROM annotations GROUP BY ALL")
def visual_counts(spark, d):
    return V.annotations(spark, d).groupBy("model", "status").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("path").alias("frames"))


@query(f"WITH {V.ANNOTATIONS} SELECT at_us // 86400000000 AS day, count(DISTINCT path) AS captioned FROM annotations WHERE status = 'complete' GROUP BY ALL")
def distinct_captioned(spark, d):
    return V.annotations(spark, d).where("status = 'complete'").groupBy(F.floor(F.col("at_us") / DAY).alias("day")).agg(F.count_distinct("path").alias("captioned"))


@query(f"WITH {V.ANNOTATIONS} SELECT model, count(*) AS n, median(elapsed_s) AS median_s, quantile_disc(elapsed_s, 0.9) AS p90_s, CAST(floor(23400 * 0.8 / quantile_disc(elapsed_s, 0.9)) AS BIGINT) AS capacity FROM annotations WHERE status = 'complete' GROUP BY model")
def model_benchmark(spark, d):
    return W.model_benchmark(V.annotations(spark, d).where("status = 'complete'"), 23_400, 0.8)


@query(f"WITH {V.ANNOTATIONS}, f AS (SELECT path, bool_or(status = 'complete') AS done, bool_or(status = 'filtered') AS held FROM annotations GROUP BY path) SELECT path % 10 AS night, count(*) AS frames, count(*) FILTER (done) AS complete, count(*) FILTER (NOT done AND held) AS sensitive, count(*) FILTER (NOT done AND NOT held) AS unresolved FROM f GROUP BY ALL")
def combined_night(spark, d):
    return W.combined(V.annotations(spark, d)).groupBy((F.col("path") % 10).alias("night")).agg(F.count(F.lit(1)).alias("frames"), F.count_if("done").alias("complete"), F.count_if(F.expr("NOT done AND held")).alias("sensitive"), F.count_if(F.expr("NOT done AND NOT held")).alias("unresolved"))


NIGHTS = f"""WITH {V.RECEIPTS}, one AS (SELECT * FROM receipts QUALIFY row_number() OVER (PARTITION BY started_us ORDER BY completed DESC, failed DESC, elapsed_cs DESC) = 1),
    nights AS (SELECT night, count(*) AS runs, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(elapsed_cs) AS BIGINT) AS elapsed_cs,
      CAST(sum(completed) + sum(failed) AS BIGINT) AS attempts, CASE WHEN sum(elapsed_cs) > 0 THEN CAST(18720 * 100 * (sum(completed) + sum(failed)) // sum(elapsed_cs) AS BIGINT) END AS capacity FROM one GROUP BY night)"""


def _nights(spark, d):
    return W.night_capacity(V.receipts(spark, d), 18_720)


@query(NIGHTS + " SELECT * FROM nights")
def night_capacity(spark, d):
    return _nights(spark, d)


@query(NIGHTS + " SELECT min(capacity) AS capacity, count(*) AS nights FROM (SELECT * FROM nights WHERE attempts >= 50 ORDER BY night DESC LIMIT 3)")
def conservative_capacity(spark, d):
    return W.conservative(_nights(spark, d), 50, 3)


@query(f"WITH {V.ANNOTATIONS}, f AS (SELECT * FROM annotations WHERE n = 1 AND status = 'incomplete') SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM annotations x WHERE x.path = f.path AND x.n = 2 AND x.status = 'complete')")
def incomplete_not_retried(spark, d):
    a = V.annotations(spark, d)
    done = a.where("n = 2 AND status = 'complete'").select("path")
    return a.where("n = 1 AND status = 'incomplete'").select("path").join(done, "path", "left_anti")


@query(f"WITH {V.ANNOTATIONS}, w AS (SELECT path FROM annotations WHERE n = 1 AND status = 'complete') SELECT w.path, coalesce(s.status, 'missing') AS strong FROM w LEFT JOIN annotations s ON s.path = w.path AND s.n = 2 WHERE s.status IS NULL OR s.status = 'incomplete'")
def upgrade_candidates(spark, d):
    a = V.annotations(spark, d)
    strong = a.where("n = 2").select("path", F.col("status").alias("s"))
    return a.where("n = 1 AND status = 'complete'").select("path").join(strong, "path", "left").where("s IS NULL OR s = 'incomplete'").select("path", F.coalesce("s", F.lit("missing")).alias("strong"))


@query(f"WITH {V.ANNOTATIONS}, g AS (SELECT path, count(*) AS attempts, bool_or(status = 'complete') AS done FROM annotations GROUP BY path) SELECT o_orderkey AS path, coalesce(attempts, 0) AS attempts FROM orders LEFT JOIN g ON g.path = o_orderkey WHERE coalesce(attempts, 0) < 2 AND NOT coalesce(done, false)")
def direct_candidates(spark, d):
    g = V.annotations(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or(F.col("status") == "complete").alias("done"))
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    return o.join(g, "path", "left").where("coalesce(attempts, 0) < 2 AND NOT coalesce(done, false)").select("path", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query(f"WITH {V.ANNOTATIONS} SELECT path, at_us FROM annotations WHERE n = 1 AND status = 'incomplete' AND at_us >= 883612800000000 QUALIFY row_number() OVER (ORDER BY at_us DESC, path) <= 100")
def retry_window(spark, d):
    return V.annotations(spark, d).where("n = 1 AND status = 'incomplete' AND at_us >= 883612800000000").select("path", "at_us").orderBy(F.desc("at_us"), "path").limit(100)


@query("WITH p AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) SELECT o_orderkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM p)")
def orphans(spark, d):
    parent = V.table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return Q.orphans(V.table(spark, d, "orders"), parent, "o_custkey").select(F.col("o_orderkey").alias("path"))


@query("SELECT event_type AS source, count(*) AS rows FROM events GROUP BY event_type")
def source_counts(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT least((SELECT min(epoch_us(ts)) FROM events), (SELECT min(epoch_us(o_orderdate)) FROM orders)) // 86400000000 AS day")
def earliest_day(spark, d):
    a = V.table(spark, d, "events").select(V.micros("ts").alias("t")).agg(F.min("t").alias("t"))
    b = V.table(spark, d, "orders").select(V.micros("o_orderdate").alias("t")).agg(F.min("t").alias("t"))
    return a.union(b).agg(F.floor(F.min("t") / DAY).alias("day"))


@query(
    """WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS k FROM documents GROUP BY source)
    SELECT source, k, n, CAST(floor((k / n::DOUBLE + 1.959963984540054 * 1.959963984540054 / (2 * n) - 1.959963984540054 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n) * 1e6 + 0.5) AS BIGINT) AS low_ppm,
    CAST(floor((k / n::DOUBLE + 1.959963984540054 * 1.959963984540054 / (2 * n) + 1.959963984540054 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n) * 1e6 + 0.5) AS BIGINT) AS high_ppm FROM g"""
)
def wilson_interval(spark, d):
    g = V.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("k"))
    return Q.wilson(g, "k", "n")


def _variants(spark, d):
    """Answers of three variants to examples: every line of an order is one, those of one example and variant are one."""
    n = F.col("l_linenumber") - 1
    x = V.table(spark, d, "lineitem").groupBy((n % 3 + 1).cast("long").alias("variant"), (F.col("l_orderkey") * 10 + F.floor(n / 3)).alias("example")).agg(F.max("l_returnflag").alias("truth"), F.max("l_quantity").alias("score"))
    return x.withColumn("guess", F.when(F.col("score") > 5, F.when(F.col("score") % 4 == 0, F.lit("A")).otherwise(F.col("truth")))).select("variant", "example", "truth", "guess", "score")


VARIANTS = "WITH y AS (SELECT CAST((l_linenumber - 1) % 3 + 1 AS BIGINT) AS variant, l_orderkey * 10 + (l_linenumber - 1) // 3 AS example, max(l_returnflag) AS truth, max(l_quantity) AS score FROM lineitem GROUP BY ALL), x AS (SELECT variant, example, truth, CASE WHEN score > 5 THEN CASE WHEN score % 4 = 0 THEN 'A' ELSE truth END END AS guess, score FROM y)"


@query(VARIANTS + " SELECT bool_and(b.score >= a.score) AS holds, count(*) FILTER (b.score < a.score) AS worse, count(*) AS pairs FROM x a JOIN x b ON a.example = b.example AND a.variant = 1 AND b.variant = 2")
def no_regression(spark, d):
    x = _variants(spark, d)
    return Q.no_regression(x.where("variant = 1"), x.where("variant = 2"), "example", "score")


@query(VARIANTS + ', m AS (SELECT variant, count(*) AS n, count(*) FILTER (guess = truth) AS r, count(*) FILTER (guess IS NULL) AS a FROM x GROUP BY variant) SELECT variant, n, r AS "right", a AS abstained FROM m WHERE r * 100 >= n * 50 ORDER BY r DESC, n DESC, variant LIMIT 1')
def select_best(spark, d):
    m = Q.variant_metrics(_variants(spark, d), "variant", "truth", "guess").drop("answered")
    return Q.select_best(m, F.col("right") * 100 >= F.col("n") * 50, ["right", "n"], "variant")


BOOTSTRAP = """, p AS (SELECT a.example % 40 AS cluster, a.score - b.score AS d FROM x a JOIN x b ON a.example = b.example AND a.variant = 1 AND b.variant = 2), s AS (SELECT cluster, sum(d) AS d, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS place FROM p GROUP BY cluster),
    c AS (SELECT count(*) AS g FROM s), k AS (SELECT draw, CAST('0x' || substr(md5(draw::VARCHAR || ':' || place::VARCHAR || ':17'), 1, 8) AS BIGINT) % g AS place FROM s, c, (SELECT unnest(range(2000)) AS draw)),
    m AS (SELECT draw, sum(s.d) / sum(s.n) AS m FROM k JOIN s USING (place) GROUP BY draw), o AS (SELECT m, row_number() OVER (ORDER BY m, draw) - 1 AS r FROM m)
    SELECT count(*) AS pairs, (SELECT g FROM c) AS clusters, CAST(floor(avg(d) * 1e6 + 0.5) AS BIGINT) AS difference_ppm, (SELECT CAST(floor(m * 1e6 + 0.5) AS BIGINT) FROM o WHERE r = 50) AS low_ppm, (SELECT CAST(floor(m * 1e6 + 0.5) AS BIGINT) FROM o WHERE r = 1950) AS high_ppm, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM p"""


@query(VARIANTS + BOOTSTRAP)
def cluster_bootstrap(spark, d):
    x = _variants(spark, d)
    a, b = x.where("variant = 1").select("example", F.col("score").alias("a")), x.where("variant = 2").select("example", F.col("score").alias("b"))
    got = Q.cluster_bootstrap(a.join(b, "example").withColumn("cluster", F.col("example") % 40), "cluster", "a", "b")
    ppm = lambda c: F.floor(F.col(c) * 1e6 + 0.5).alias(f"{c}_ppm")
    return got.select("pairs", "clusters", ppm("difference"), ppm("low"), ppm("high"), "wins", "losses", "ties")


@query(VARIANTS + ", r AS (SELECT *, substr(sha256(concat_ws(':', '9', example, variant)), 1, 16) AS review_id FROM x) SELECT review_id, truth, guess, CAST(score AS BIGINT) AS score FROM r")
def blind_assessment(spark, d):
    return Q.blind(_variants(spark, d), "example", "variant", 9)[0].withColumn("score", F.col("score").cast("long"))


COMMANDS = f"""WITH {V.SAMPLES}, cm AS (SELECT id, start_us // 900000000 AS slot, device, start_us AS at_us, CASE state WHEN 'active' THEN 'set' WHEN 'unattributed' THEN 'clear' ELSE 'mark' END AS op, 'L' || (k % 3)::VARCHAR AS label FROM samples WHERE id % 3 = 0),
    la AS (SELECT *, row_number() OVER (PARTITION BY device, slot ORDER BY at_us DESC, id DESC) AS r FROM cm WHERE op IN ('set', 'clear')), fs AS (SELECT device, slot, min(at_us) AS first_us FROM cm WHERE op = 'set' GROUP BY ALL),
    current AS (SELECT la.device, la.slot, label, first_us, la.at_us FROM la JOIN fs USING (device, slot) WHERE r = 1 AND op = 'set')"""


def _commands(spark, d):
    op = F.when(F.col("state") == "active", "set").when(F.col("state") == "unattributed", "clear").otherwise("mark")
    return V.samples(spark, d).where("id % 3 = 0").select("id", F.floor(F.col("start_us") / (15 * MINUTE)).alias("slot"), "device", F.col("start_us").alias("at_us"), op.alias("op"), F.concat(F.lit("L"), (F.col("k") % 3).cast("string")).alias("label"))


@query(COMMANDS + " SELECT device, slot, label, first_us FROM current")
def apply_corrections(spark, d):
    return W.apply_corrections(_commands(spark, d), ["device", "slot"])


@query(COMMANDS + ", lc AS (SELECT device, slot, max(at_us) AS epoch FROM (SELECT device, slot, at_us, label, lag(label) OVER (PARTITION BY device, slot ORDER BY at_us, id) AS before FROM cm WHERE op IN ('set')) WHERE before IS DISTINCT FROM label GROUP BY ALL) SELECT cm.device, cm.slot, count(*) AS outcomes FROM cm JOIN current USING (device, slot) JOIN lc USING (device, slot) WHERE cm.op = 'mark' AND cm.at_us >= lc.epoch GROUP BY ALL")
def active_outcomes(spark, d):
    return W.active_outcomes(_commands(spark, d), ["device", "slot"])


@query(COMMANDS + " SELECT device, slot, label, substr(sha256(concat_ws('|', device, slot, label)), 1, 16) AS revision FROM current")
def current_corrections(spark, d):
    now = W.apply_corrections(_commands(spark, d), ["device", "slot"])
    return now.select("device", "slot", "label", F.substr(F.sha2(F.concat_ws("|", F.col("device").cast("string"), F.col("slot").cast("string"), "label"), 256), F.lit(1), F.lit(16)).alias("revision"))


@query(f"WITH {V.RUNS} SELECT device, day, start_us, end_us, coalesce(CASE WHEN id % 2 = 0 THEN 'kept-' || id::VARCHAR END, substr(sha256(concat_ws('|', device, start_us, end_us)), 1, 12)) AS block_id FROM runs")
def stable_block_ids(spark, d):
    runs = _runs(spark, d)
    prior = runs.where("id % 2 = 0").select("device", "start_us", "end_us", F.concat(F.lit("kept-"), F.col("id").cast("string")).alias("prior_id"))
    return W.stable_ids(runs, prior, ["device", "start_us", "end_us"]).select("device", "day", "start_us", "end_us", "block_id")


@query(f"WITH {V.RUNS}, x AS (SELECT device, day, count(*) AS n FROM runs GROUP BY ALL) SELECT device, day, n FROM x WHERE day % 4 = 1 OR day > (SELECT max(day) - 8 FROM x)")
def incremental_days(spark, d):
    """Days whose input changed since the stored fingerprints, and the last eight."""
    runs = _runs(spark, d).select("id", "device", "day", "start_us", "end_us")
    stored = R.touched_days(runs, runs.groupBy(*A.KEYS).agg(F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("h")))
    stored = stored.withColumn("n", F.when(F.col("day") % 4 == 1, F.col("n") + 1).otherwise(F.col("n")))
    return R.touched_days(runs, stored).select("device", "day", "n")


@query("WITH c AS (SELECT user_id, epoch_us(ts) AS t, event_id, value, lag(value) OVER w AS v0, lag(epoch_us(ts)) OVER w AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id AS id, CASE WHEN v0 IS NULL OR value < v0 THEN NULL ELSE CAST(floor((value - v0) * 1e9 / (t - t0) + 0.5) AS BIGINT) END AS rate FROM c")
def counter_intervals(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", V.micros("ts").alias("t"), "value")
    return W.counter_rates(e, ["user_id"], "t", "value").select("id", F.floor(F.col("per_us") * 1e9 + 0.5).alias("rate"))


@query("SELECT item.doc_id AS id, CAST(len(list_filter(string_split(item.text, ' '), lambda x: x = 'the')) AS BIGINT) AS the_words FROM documents item")
def evidence_words(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(F.filter(F.split("text", " "), lambda x: x == "the")).cast("long").alias("the_words"))


