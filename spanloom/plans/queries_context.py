"""Queries of screen evidence: tags, captions, aliases, topics, chapters, summaries and who may use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.time import DAY, HOUR, SECOND
from spanloom.operators import activity as A
from spanloom.operators import context as C
from spanloom.operators import interval as I
from spanloom.operators.asof import asof, nearest
from spanloom.operators.evidence import first_reason
from spanloom.operators.rank import top_k
from spanloom.plans.book import Book
from spanloom.plans.queries_activity import FACTS, OVERLAP, _facts, _runs, _segs, _stretches
from spanloom.plans.queries_text import _ladder, _q
from spanloom.sources import adapters as V

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql

MARKS = f"marks AS (SELECT device, {V.EPOCH_2024} + id * 7919 % 2592000 * 1000000 AS mark_us, id AS ord, display AS topic, CASE WHEN id % 3 <> 0 THEN 'app' || (id % 2)::VARCHAR END AS app FROM frames)"


def _marks(spark, d):
    i = F.col("id")
    """Frames spread over the month of the samples."""
    return V.frames(spark, d).select("device", (V.EPOCH_2024 + i * 7919 % 2_592_000 * SECOND).alias("mark_us"), i.alias("ord"), F.col("display").alias("topic"), F.when(i % 3 != 0, F.concat(F.lit("app"), (i % 2).cast("string"))).alias("app"))


SLOTS = "slots AS (SELECT device, day, start_us, end_us, app, sampled_us, us, start_us + j * 5000000 + us // 2 AS mid FROM (SELECT *, least(5000000, end_us - start_us - j * 5000000) AS us FROM (SELECT *, unnest(range(0, (end_us - start_us - 1) // 5000000 + 1)) AS j FROM segments WHERE state = 'unattributed')))"
NEAREST = f"""WITH {V.SEGMENTS}, {V.FRAMES}, {MARKS}, {SLOTS}, near AS (SELECT s.device, s.day, s.start_us, s.end_us, s.app, s.sampled_us, s.us, s.mid, arg_min(m.topic, (abs(m.mark_us - s.mid), m.ord)) AS topic FROM slots s JOIN marks m ON m.device = s.device AND abs(m.mark_us - s.mid) <= 30000000 AND coalesce(m.app = s.app, true) GROUP BY ALL)"""


@query(NEAREST + " SELECT device, day, mid, app, topic FROM near WHERE topic IS NOT NULL")
def nearest_within(spark, d):
    """The nearest frame's display within 30 s of each 5 s step of unattributed segments, where the apps agree."""
    steps = C.slots(_segs(spark, d).where("state = 'unattributed'")).select("device", "day", "mid", "app")
    return nearest(steps, _marks(spark, d), ["device"], "mid", 30 * SECOND, "topic", same="app").where("topic IS NOT NULL")


@query(NEAREST + ", per AS (SELECT device, day, start_us, end_us, sampled_us, topic, sum(us) AS us FROM near WHERE topic IS NOT NULL GROUP BY ALL) SELECT device, day, topic, CAST(sum(CAST(floor(us * least(1.0::DOUBLE, sampled_us::DOUBLE / (end_us - start_us)::DOUBLE) + 0.5) AS BIGINT)) AS BIGINT) AS us FROM per GROUP BY ALL")
def screen_suggested(spark, d):
    return C.screen_suggested(_segs(spark, d).where("state = 'unattributed'"), _marks(spark, d), A.KEYS)


@query(
    f"""WITH {V.SCREENS}, t AS (SELECT l.doc_id AS id, s.at_us + CASE WHEN l.doc_id % 7 = 0 THEN 1000000 ELSE 0 END AS at_us, CASE WHEN l.doc_id % 11 = 0 THEN '' ELSE 'q' || quality::VARCHAR END AS topic, CASE WHEN l.doc_id % 5 = 0 THEN 'unclassified' ELSE 'model_inference' END AS status FROM labels l JOIN screens s ON s.id = l.doc_id
      UNION ALL SELECT id, at_us, 'seen', 'featureprint_match' FROM screens WHERE id % 17 = 0 AND id % 2 = 0)
    SELECT t.id, t.at_us, topic, t.status, s.app AS app_hint FROM t JOIN screens s ON s.id = t.id AND s.at_us = t.at_us AND s.id % 5 <> 1 WHERE t.status <> 'unclassified' AND topic <> ''"""
)
def tag_to_source(spark, d):
    """Checked and propagated tags whose frame is still there, at the very moment that the tag tells."""
    s, i = V.screens(spark, d), F.col("id")
    l = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality").join(s.select("id", "at_us"), "id")
    checked = l.select("id", (F.col("at_us") + F.when(i % 7 == 0, SECOND).otherwise(0)).alias("at_us"), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("topic"), F.when(i % 5 == 0, "unclassified").otherwise("model_inference").alias("status"))
    propagated = s.where("id % 17 = 0").select("id", "at_us", F.lit("seen").alias("topic"), F.lit("featureprint_match").alias("status"), (2 - i % 2).alias("version"))
    return C.supported_tags(checked, propagated, s.where("id % 5 <> 1"), 2)


@query(
    f"""WITH {V.RUNS}, {V.SCREENS}, x AS (SELECT id, device, status, win, EXISTS (SELECT 1 FROM runs r WHERE r.device = s.device AND r.state = 'unattributed' AND s.at_us >= r.start_us AND s.at_us < r.end_us) AS inside, regexp_matches(concat_ws(' ', app, CASE WHEN id % 13 = 0 THEN 'bank account' ELSE text END), {_q(T.SENSITIVE)}) AS bad FROM screens s)
    SELECT id, device, CASE WHEN status <> 'complete' THEN 'ocr' WHEN win IS NOT NULL THEN 'titled' WHEN NOT inside THEN 'outside' WHEN bad THEN 'sensitive' ELSE 'ok' END AS reason FROM x"""
)
def eligible_frames(spark, d):
    """Frames that may be read for a topic: read, untitled, in an unattributed run and not sensitive; else why not."""
    s = V.screens(spark, d).withColumn("text", F.when(F.col("id") % 13 == 0, "bank account").otherwise(F.col("text")))
    return C.eligible_frames(s, _runs(spark, d).where("state = 'unattributed'").select("device", "start_us", "end_us"), ["device"]).select("id", "device", "reason")


PACK = f"""WITH {V.SCREENS}, files AS (SELECT o_orderkey AS ref, o_custkey % 4 AS device, {V.EPOCH_2024} + (o_orderkey % 100) * 10000000 + ((o_orderkey // 100) % 100) * 259200000000 AS at_us, CASE o_custkey % 4 WHEN 0 THEN 'that' WHEN 1 THEN 'PARA' WHEN 2 THEN 'the' ELSE 'oder' END AS name FROM orders),
    nr AS (SELECT a.id, b.id AS ref, a.at_us, b.at_us AS o_us, a.app IS NOT DISTINCT FROM b.app AND a.win IS NOT DISTINCT FROM b.win AS same, row_number() OVER (PARTITION BY a.id ORDER BY b.at_us DESC, b.id DESC) AS rank FROM screens a JOIN screens b ON a.device = b.device AND a.id <> b.id AND b.at_us >= a.at_us - 120000000 AND b.at_us < a.at_us + 1000000),
    fr AS (SELECT a.id, f.ref, lower(f.name) AS name, ' ' || regexp_replace(lower(concat_ws(' ', a.win, a.text)), '[^a-z0-9]+', ' ', 'g') || ' ' AS words, row_number() OVER (PARTITION BY a.id ORDER BY f.at_us DESC, f.ref DESC) AS rank FROM screens a JOIN files f ON a.device = f.device AND f.at_us >= a.at_us - 120000000 AND f.at_us < a.at_us + 1000000)
    SELECT id, 'nearby' AS kind, ref, rank FROM nr WHERE rank <= 3 AND same AND at_us // 86400000000 = o_us // 86400000000 UNION ALL SELECT id, 'file', ref, rank FROM fr WHERE rank <= 3 AND length(name) >= 4 AND contains(words, ' ' || name || ' ')"""


@query(PACK)
def evidence_pack(spark, d):
    """Up to three frames of one window in the two minutes before, and file changes that title or text name."""
    i, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    at = V.EPOCH_2024 + (i % 100) * 10 * SECOND + (F.floor(i / 100) % 100) * 3 * DAY
    files = V.table(spark, d, "orders").select(i.alias("ref"), c.alias("device"), at.alias("at_us"), F.when(c == 0, "that").when(c == 1, "PARA").when(c == 2, "the").otherwise("oder").alias("name"))
    return C.evidence_pack(V.screens(spark, d), files, ["device"])


@query(
    """WITH b AS (SELECT c_custkey AS binding, c_nationkey AS project, unnest([c_custkey % 50, c_custkey % 50 + 1]) AS observation, lower(c_name) AS a1, lower(c_mktsegment) || ' x' AS a2 FROM customer), e AS (SELECT binding, project, observation, unnest([a1, a2]) AS alias FROM b),
    c AS (SELECT o_orderkey AS id, o_custkey % 50 AS observation, o_orderkey % 7 <> 0 AS cited, CASE o_orderkey % 3 WHEN 0 THEN 'customer#' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'building x' END AS alias, o_orderkey % 2 = 0 AS task, o_custkey % 25 AS project FROM orders),
    m AS (SELECT c.id, CASE WHEN count(DISTINCT binding) = 1 THEN min(binding) END AS resolved FROM c JOIN e ON e.observation = c.observation AND e.alias = c.alias AND (NOT task OR e.project = c.project) WHERE cited GROUP BY c.id) SELECT c.id, m.resolved FROM c LEFT JOIN m USING (id)"""
)
def alias_resolution(spark, d):
    """Names that claims use, resolved by aliases that the cited observation anchors."""
    c, i, o = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    bindings = V.table(spark, d, "customer").select(c.alias("binding"), F.col("c_nationkey").cast("long").alias("project"), F.array(c % 50, c % 50 + 1).alias("observations"), F.array("c_name", F.concat("c_mktsegment", F.lit("  X "))).alias("aliases"))
    name = F.when(i % 3 == 0, F.concat(F.lit(" customer#"), F.lpad(o.cast("string"), 9, "0"))).when(i % 3 == 1, "BUILDING \n x")
    asked = V.table(spark, d, "orders").select(i.alias("id"), (o % 50).alias("observation"), (i % 7 != 0).alias("cited"), name.alias("candidate"), (i % 2 == 0).alias("task"), (o % 25).alias("project"))
    return C.resolve_aliases(asked, bindings).select("id", "resolved")


@query(f"WITH {V.SCREENS}, {V.CAPTIONS}, g AS (SELECT id, string_agg(caption, '|' ORDER BY ord, caption) AS captions, count(*) AS n FROM captions WHERE status = 'complete' GROUP BY id) SELECT s.id, s.device, coalesce(captions, '') AS captions, coalesce(n, 0) AS n FROM screens s LEFT JOIN g USING (id) WHERE s.app IS NULL UNION ALL SELECT s.id, s.device, coalesce(captions, ''), coalesce(n, 0) FROM screens s LEFT JOIN g USING (id) WHERE s.app = 'app1'")
def frames_with_captions(spark, d):
    """Frames of one app, and those of none, with their completed captions."""
    s, c = V.screens(spark, d), V.captions(spark, d)
    both = C.visual_evidence(s, c, None).unionByName(C.visual_evidence(s, c, "app1"))
    return both.select("id", "device", F.array_join("captions", "|").alias("captions"), F.size("captions").cast("long").alias("n"))


@query(f"WITH {V.SCREENS}, {V.CAPTIONS}, r AS (SELECT app, win, caption, row_number() OVER (PARTITION BY app, win ORDER BY at_us, s.id, ord) AS r FROM captions c JOIN screens s ON s.id = c.id WHERE c.status = 'complete' AND win IS NOT NULL) SELECT app, win, string_agg(caption, '|' ORDER BY r) AS captions FROM r WHERE r <= 2 GROUP BY ALL")
def caption_fill(spark, d):
    """The first two completed captions of each titled window."""
    return C.window_captions(V.screens(spark, d), V.captions(spark, d)).select("app", "win", F.array_join("captions", "|").alias("captions"))


@query(f"WITH {V.CAPTIONS}, g AS (SELECT id, coalesce(string_agg(caption, '|' ORDER BY ord, caption) FILTER (model = 'strong'), '') AS captions FROM captions GROUP BY id) SELECT g.id, 'k' || toxic::VARCHAR AS kind, captions FROM g JOIN labels ON doc_id = g.id WHERE quality = 1")
def focus_accepted(spark, d):
    """Chapters with an accepted result: its kind, and the strong model's captions."""
    per = V.captions(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "caption", "model"))).alias("captions"))
    results = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "complete").otherwise("failed").alias("status"), F.concat(F.lit("k"), F.col("toxic").cast("string")).alias("kind"))
    return C.accepted_chapters(per, results).select("id", "kind", F.array_join("captions", "|").alias("captions"))


@query(
    f"""WITH {V.ANNOTATIONS}, r AS (SELECT o_orderkey AS run, epoch_us(o_orderdate) // 86400000000 AS night, o_custkey % 2 AS model, epoch_us(o_orderdate) + (o_orderkey % 7) * 3600000000 AS started_us, epoch_us(o_orderdate) + (o_orderkey % 5) * 86400000000 + 86399000000 AS finished_us FROM orders WHERE o_orderstatus = 'F'),
    l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY night, model ORDER BY started_us DESC, run DESC) = 1)
    SELECT DISTINCT run, night, l.model, path FROM l JOIN annotations a ON a.model = l.model AND a.status = 'complete' AND a.at_us >= started_us AND a.at_us <= finished_us"""
)
def latest_completed_run(spark, d):
    """Frames that each night's latest completed run of a model finished."""
    i, at = F.col("o_orderkey"), V.micros("o_orderdate")
    runs = V.table(spark, d, "orders").select(i.alias("run"), F.floor(at / DAY).alias("night"), (F.col("o_custkey") % 2).alias("model"), (at + (i % 7) * HOUR).alias("started_us"), (at + (i % 5) * DAY + 86_399 * SECOND).alias("finished_us"), (F.col("o_orderstatus") == "F").alias("completed"))
    return C.run_annotations(runs, V.annotations(spark, d))


@query("SELECT o_orderkey AS id, concat_ws(',', 'failed=' || o_custkey::VARCHAR, CASE WHEN regexp_matches(o_orderpriority, '^[a-zA-Z0-9_+-]{1,80}$') THEN 'status=' || o_orderpriority END, 'stop_reason=' || o_orderstatus) AS fields FROM orders")
def private_status_only(spark, d):
    """Known fields with values of a safe shape leave, nothing else does."""
    pairs = [F.lit("status"), F.col("o_orderpriority"), F.lit("stop_reason"), F.col("o_orderstatus"), F.lit("note"), F.lit("free text"), F.lit("failed"), F.col("o_custkey").cast("string")]
    safe = F.map_entries(C.private_fields(F.create_map(*pairs)))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_sort(F.transform(safe, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("fields"))


@query(f"WITH {V.STRETCHES} SELECT device, start_us, context AS label FROM stretches WHERE contains(lower(context || ' ' || string_split(context, '/')[1]), 'pp1') AND device = 2 ORDER BY start_us, label LIMIT 50")
def search_intervals(spark, d):
    """The first fifty stretches of a device whose label or apps have a text."""
    s = _stretches(spark, d).select("device", "start_us", F.col("context").alias("label"), F.array(F.substring_index("context", "/", 1)).alias("apps"))
    return C.search(s, " PP1 ", 2).select("device", "start_us", "label")


TOPICS = f"""tags2 AS (SELECT app, win, CASE WHEN app = 'app1' AND win = 'w1' THEN 'video page' ELSE min('project ' || source) END AS topic FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'app0' ELSE 'app1' END AS app, 'w' || ((id // 2) % 2)::VARCHAR AS win, app AS source FROM frames) WHERE NOT (app = 'app0' AND win = 'w0') GROUP BY app, win),
    al AS (SELECT s.device, s.day, coalesce(CASE WHEN t.topic <> 'video page' THEN t.topic END, {_ladder("s.win", "s.app", "NULL::VARCHAR")}) AS label, CASE WHEN t.topic <> 'video page' THEN 'specific_model' ELSE 'broad_context' END AS status, sampled_us FROM segments s LEFT JOIN tags2 t ON t.app = s.app AND t.win = s.win WHERE s.state = 'active')"""


def _tags(spark, d):
    i = F.col("id")
    f = V.frames(spark, d).select(F.concat(F.lit("app"), (i % 2).cast("string")).alias("app"), F.concat(F.lit("w"), (F.floor(i / 2) % 2).cast("string")).alias("win"), F.col("app").alias("source")).where("NOT (app = 'app0' AND win = 'w0')")
    tags = f.groupBy("app", "win").agg(F.min(F.concat(F.lit("project "), "source")).alias("topic")).withColumn("status", F.lit("model_inference"))
    return tags.withColumn("topic", F.when((F.col("app") == "app1") & (F.col("win") == "w1"), "video page").otherwise(F.col("topic")))


def _topics(spark, d, segs=None):
    tags = _tags(spark, d)
    return C.allocate_topics(_segs(spark, d) if segs is None else segs, tags, A.KEYS)


@query(f"WITH {V.SEGMENTS}, {V.FRAMES}, {TOPICS} SELECT device, day, label, status, CAST(sum(sampled_us) AS BIGINT) AS us FROM al GROUP BY ALL")
def topic_allocation(spark, d):
    """Active time to a window's specific topic, else to an honest broad context."""
    return _topics(spark, d)


TOPIC_STRETCHES = f"""{V.SEGMENTS}, {V.FRAMES}, {TOPICS},
    sg AS (SELECT s.device, s.day, s.start_us, s.end_us, s.state, coalesce(s.app, '') || chr(1) || coalesce(s.win, '') AS exact, s.sampled_us, s.app, CASE WHEN t.topic <> 'video page' THEN t.topic END AS topic, coalesce(CASE WHEN t.topic <> 'video page' THEN t.topic END, nullif(s.win, ''), {_ladder("s.win", "s.app", "NULL::VARCHAR")}) AS label, s.state = 'active' AND s.sampled_us > 0 AS seen FROM segments s LEFT JOIN tags2 t ON t.app = s.app AND t.win = s.win),
    nx AS (SELECT *, coalesce('topic ' || topic, exact) AS own, seen AND coalesce(lag(seen) OVER w AND start_us - lag(end_us) OVER w BETWEEN 0 AND {{gap}}, false) AS next FROM sg WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
    mv AS (SELECT *, next AND lag(own) OVER w <> own AS moved, next AND lag(exact) OVER w <> exact AS turned FROM nx WINDOW w AS (PARTITION BY device, day ORDER BY start_us)),
    st AS (SELECT *, sum(CASE WHEN seen AND (NOT next OR moved) THEN 1 ELSE 0 END) OVER (PARTITION BY device, day ORDER BY start_us) AS n FROM mv),
    ap AS (SELECT device, day, n, string_agg(app, ',' ORDER BY since) AS apps FROM (SELECT device, day, n, app, min(start_us) AS since FROM st WHERE seen AND app <> '' GROUP BY ALL) GROUP BY ALL),
    ts AS (SELECT device, day, label, status, start_us, end_us, us, coalesce(apps, '') AS apps, switched, window_switches FROM (SELECT device, day, n, min(label) AS label, CASE WHEN min(topic) IS NULL THEN 'observed_window' ELSE 'specific_model' END AS status, min(start_us) AS start_us, max(end_us) AS end_us, CAST(sum(sampled_us) AS BIGINT) AS us, bool_or(moved) AS switched, CAST(sum(turned::INT) AS BIGINT) AS window_switches FROM st WHERE seen GROUP BY device, day, n) LEFT JOIN ap USING (device, day, n))"""
#: Samples of the tables lie further apart than those of a device that is in use.
NEXT_US = 1800 * SECOND
TOPIC_STRETCHES = TOPIC_STRETCHES.format(gap=NEXT_US)


def _topic_stretches(spark, d):
    return C.topic_stretches(_segs(spark, d), _tags(spark, d), A.KEYS, NEXT_US)


@query(f"WITH {TOPIC_STRETCHES} SELECT * FROM ts")
def topic_stretches(spark, d):
    """Stretches of one topic or exact window, with their apps in order of appearance."""
    return _topic_stretches(spark, d).withColumn("apps", F.array_join("apps", ","))


def _measures_sql(by: str) -> str:
    return f"""WITH {TOPIC_STRETCHES} SELECT {by}, count(*) AS sessions, count(*) FILTER (switched) AS context_switches, CAST(sum(window_switches) AS BIGINT) AS window_switches, CAST(sum(us) AS BIGINT) AS us, CAST(floor(median(us)) AS BIGINT) AS median_us, max(us) AS longest_us,
    CAST(sum(CASE WHEN us >= 1200000000 THEN us ELSE 0 END) AS BIGINT) AS sustained_us, count(*) FILTER (us < 120000000) AS brief, CAST(count(*) FILTER (switched)::HUGEINT * 3600000000000 // sum(us) AS BIGINT) AS switches_per_hour_x1000 FROM ts GROUP BY {by}"""


@query(_measures_sql("device, day"))
def topic_stretch_measures(spark, d):
    return C.stretch_measures(_topic_stretches(spark, d), A.KEYS)


@query(_measures_sql("device"))
def topic_stretch_measures_of_periods(spark, d):
    return C.stretch_measures(_topic_stretches(spark, d), ["device"])


@query(f"WITH {V.SEGMENTS}, {V.FRAMES}, {TOPICS} SELECT device, label, status, CAST(sum(sampled_us) AS BIGINT) AS us, count(DISTINCT day) AS days FROM al WHERE sampled_us > 0 GROUP BY ALL")
def merge_contexts(spark, d):
    """Topic totals of all days of a device, by label and status."""
    return _topics(spark, d).where("us > 0").groupBy("device", "label", "status").agg(F.sum("us").alias("us"), F.count(F.lit(1)).alias("days"))


@query(
    f"""WITH {V.FRAMES}, h AS (SELECT doc_id AS id, doc_id // 10 AS episode, f.at_us, f.at_us - 20000000 AS low_us, f.at_us + CASE WHEN doc_id % 31 = 0 THEN 50000000 ELSE 20000000 END AS high_us FROM labels l JOIN frames f ON f.id = l.doc_id),
    e AS (SELECT id // 10 AS episode, min(at_us) - 60000000 AS start_us, max(at_us) + 60000000 AS end_us FROM frames WHERE (id // 10) % 13 <> 0 GROUP BY ALL)
    SELECT h.id, CASE WHEN h.id % 37 = 0 THEN 'version' WHEN h.id % 41 = 0 THEN 'tier' WHEN e.episode IS NULL THEN 'episode_missing' WHEN h.episode % 11 = 0 THEN 'episode_changed' WHEN h.id % 29 = 0 THEN 'source_missing' WHEN h.id % 23 = 0 THEN 'source_moved' WHEN h.id % 19 = 0 THEN 'image_changed' WHEN h.id % 17 = 0 THEN 'runtime_changed'
      WHEN NOT (start_us <= low_us AND high_us <= end_us) THEN 'scope' WHEN h.episode % 7 = 0 THEN 'not_foreground' WHEN h.episode % 9 = 0 THEN 'barrier' WHEN high_us - low_us > 60000000 THEN 'too_long' ELSE 'ok' END AS reason FROM h LEFT JOIN e ON e.episode = h.episode"""
)
def freshness_gate(spark, d):
    """The first thing that changed since a hypothesis was made, or ok."""
    i, n = F.col("id"), F.floor(F.col("id") / 10)
    f = V.frames(spark, d).select("id", "at_us")
    same = lambda bad: F.when(bad, "other").otherwise("same")
    h = V.table(spark, d, "labels").select(F.col("doc_id").alias("id")).join(f, "id").select(
        "id", F.when(i % 37 == 0, 1).otherwise(2).alias("version"), F.when(i % 41 == 0, "observed").otherwise("model_hypothesis").alias("tier"), n.alias("episode"), F.lit("same").alias("episode_sha"), i.alias("observation"), "at_us",
        (F.col("at_us") - 20 * SECOND).alias("low_us"), (F.col("at_us") + F.when(i % 31 == 0, 50 * SECOND).otherwise(20 * SECOND)).alias("high_us"), F.lit("same").alias("image_sha"), same(i % 17 == 0).alias("model_sha"),
    )
    e = f.groupBy(n.alias("episode")).agg((F.min("at_us") - 60 * SECOND).alias("start_us"), (F.max("at_us") + 60 * SECOND).alias("end_us")).where("episode % 13 <> 0")
    e = e.select("episode", same(F.col("episode") % 11 == 0).alias("sha"), "start_us", "end_us", F.when(F.col("episode") % 7 == 0, "idle").otherwise("active").alias("state"), (F.col("episode") % 9 == 0).alias("barrier"))
    s = f.where("id % 29 <> 0").select(i.alias("observation"), (F.col("at_us") + F.when(i % 23 == 0, 1).otherwise(0)).alias("at_us"), same(i % 19 == 0).alias("image_sha"))
    return C.fresh_hypotheses(h, e, s, {"model_sha": "same"}, 2)


CHAPTERS = f"""WITH {V.SEGMENTS}, cx AS (SELECT device, day, slot, app, win, sum(least(end_us, (slot + 1) * 3600000000) - greatest(start_us, slot * 3600000000)) AS us FROM (SELECT *, unnest(range(start_us // 3600000000, (end_us - 1) // 3600000000 + 1)) AS slot FROM segments WHERE state = 'active') GROUP BY ALL),
    ch AS (SELECT device, day, slot, CAST(sum(us) AS BIGINT) AS us, arg_min(app, (-us, app || '/' || win)) AS app, arg_min(win, (-us, app || '/' || win)) AS win, CAST(max(us) AS BIGINT) AS top_us FROM cx GROUP BY ALL),
    kd AS (SELECT doc_id % 4 AS device, {V.EPOCH_2024 // HOUR} + doc_id % 720 AS slot, min('k' || (quality * 2 + toxic)::VARCHAR) AS kind FROM labels GROUP BY ALL)"""


def _chapters(spark, d):
    return C.chapters(_segs(spark, d), HOUR, A.KEYS)


@query(CHAPTERS + " SELECT ch.device, ch.day, coalesce(kind, 'unclear') AS kind, count(*) AS chapters, CAST(sum(us) AS BIGINT) AS us FROM ch LEFT JOIN kd USING (device, slot) GROUP BY ALL")
def kind_totals(spark, d):
    """Time by the kind that a chapter's accepted result tells, else unclear; chapters are hours of a device here."""
    i = F.col("doc_id")
    kinds = V.table(spark, d, "labels").groupBy((i % 4).alias("device"), (V.EPOCH_2024 // HOUR + i % 720).alias("slot")).agg(F.min(F.concat(F.lit("k"), (F.col("quality") * 2 + F.col("toxic")).cast("string"))).alias("kind"))
    met = _chapters(spark, d).join(kinds, ["device", "slot"], "left")
    return met.groupBy(*A.KEYS, F.coalesce("kind", F.lit("unclear")).alias("kind")).agg(F.count(F.lit(1)).alias("chapters"), F.sum("us").alias("us"))


@query(CHAPTERS + f" SELECT device, day, slot, us, CASE WHEN top_us * 2 >= us THEN {_ladder('win', 'app', 'NULL::VARCHAR')} END AS topic FROM ch")
def chapter_topics(spark, d):
    """A chapter has a topic only if its top window holds half of its time."""
    return _chapters(spark, d).select("device", "day", "slot", "us", F.when(F.col("top_us") * 2 >= F.col("us"), T.broad_context(F.col("win"), F.col("app"))).alias("topic"))


@query(
    """WITH b AS (SELECT conv_id, turn, length(text) AS n, length(text) % 9 <> 0 AS ok, role = 'user' AS inp, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = b.conv_id AND (c.turn = b.turn - 1 OR c.turn = b.turn - 2) AND c.role = 'assistant') AS cited FROM conversations b)
    SELECT conv_id, count(*) AS blocks, count(*) FILTER (ok) AS complete, CAST(sum(n) AS BIGINT) AS amount, count(*) FILTER (ok AND inp) AS input_blocks, CAST(coalesce(sum(n) FILTER (ok AND inp), 0) AS BIGINT) AS input_amount, count(*) FILTER (ok AND inp AND cited) AS cited_blocks, CAST(coalesce(sum(n) FILTER (ok AND inp AND cited), 0) AS BIGINT) AS cited_amount FROM b GROUP BY conv_id"""
)
def summary_coverage(spark, d):
    """How much of a conversation a summary had as its input, and how much it cites."""
    c, t = V.table(spark, d, "conversations"), F.col("turn")
    blocks = c.select("conv_id", t.alias("block"), F.length("text").cast("long").alias("amount"), (F.length("text") % 9 != 0).alias("complete"))
    inputs = c.where("role = 'user'").select("conv_id", F.array(t, t).alias("ids"))
    cited = c.where("role = 'assistant'").select("conv_id", F.array(t + 1, t + 2, t + 1000).alias("ids"))
    return C.summary_coverage(blocks, inputs, cited, "conv_id")


@query(
    """WITH c AS (SELECT conv_id, bool_or(length(text) % 31 = 0) AS gone, bool_or(length(text) % 29 = 3) AS changed FROM conversations GROUP BY conv_id)
    SELECT conv_id, NOT gone AND NOT changed AND conv_id % 11 <> 3 AND conv_id % 13 <> 4 AS "current" FROM c"""
)
def stale_summaries(spark, d):
    """A summary is current only if every block it cites is there with the same input, once, and its themes cite these."""
    c, t, n = V.table(spark, d, "conversations"), F.col("turn"), F.length("text")
    one = c.select("conv_id", t.alias("block"), F.md5("text").alias("input_sha"), n.alias("n"))
    cited = one.select("conv_id", "block", F.when(F.col("n") % 29 == 3, "old").otherwise(F.col("input_sha")).alias("input_sha"))
    twice = cited.where("conv_id % 11 = 3")
    themes = c.select("conv_id", F.when(F.col("conv_id") % 13 == 4, F.array(t, t + 1000)).otherwise(F.array(t)).alias("ids"))
    return C.current_summaries(cited.unionByName(twice), themes, one.where("n % 31 <> 0"), "conv_id")


@query("SELECT doc_id AS id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 'cached' WHEN n_chars % 200 < 60 THEN 'insufficient_context' ELSE 'pending' END AS lane FROM documents d LEFT JOIN labels l USING (doc_id)")
def reuse_or_pending(spark, d):
    """What a cache of results answers, what is too short to ask, and what is to be asked."""
    i = F.col("id")
    f = V.frames(spark, d).select("id", F.md5(F.coalesce("text", F.lit(""))).alias("input_sha"), (F.col("n_chars") % 200).alias("amount"))
    cache = f.join(V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id").select("id", F.when(i % 7 == 0, "old").otherwise(F.col("input_sha")).alias("input_sha"), F.lit("m").alias("model"), F.when(i % 5 == 0, 1).otherwise(2).alias("version"), F.when(F.col("quality") == 1, "complete").otherwise("failed").alias("status"))
    return C.reuse_or_pending(f, cache, "m", 2).select("id", "lane")


@query(
    """WITH g AS (SELECT conv_id, turn AS ord, CASE turn % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'ALPHA' WHEN 2 THEN 'unclear' ELSE 'Beta' END AS label, unnest([turn + 1, turn + 3, turn + 900]) AS block FROM conversations WHERE turn % 3 <> 2),
    o AS (SELECT conv_id, block, arg_min(label, ord) AS label, min(ord) AS ord FROM g GROUP BY ALL), m AS (SELECT c.conv_id, length(text) AS n, coalesce(o.label, 'Unclear') AS label, coalesce(o.ord, 1099511627776) AS ord, o.label IS NULL AS rest FROM conversations c LEFT JOIN o ON o.conv_id = c.conv_id AND o.block = c.turn)
    SELECT conv_id, arg_min(label, (ord, label)) AS label, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS amount, CASE WHEN arg_min(rest, (ord, label)) THEN 'unclassified' ELSE 'model_inference' END AS status FROM m GROUP BY conv_id, lower(label)"""
)
def merge_groups(spark, d):
    """Groups of turns: the first group to name a turn has it, labels merge whatever their case, the rest is Unclear."""
    c, t = V.table(spark, d, "conversations"), F.col("turn")
    blocks = c.select("conv_id", t.alias("block"), F.length("text").cast("long").alias("amount"))
    label = F.when(t % 4 == 0, "Alpha").when(t % 4 == 1, "ALPHA").when(t % 4 == 2, "unclear").otherwise("Beta")
    groups = c.where("turn % 3 <> 2").select("conv_id", t.alias("ord"), label.alias("label"), F.array(t + 1, t + 3, t + 900).alias("ids"))
    return C.merge_groups(blocks, groups, "conv_id")


@query("SELECT c_custkey AS context, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND coalesce(n, 0) >= 3 AS enabled FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT date_trunc('day', o_orderdate)) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def promotion_gate(spark, d):
    """A model may allocate time only with a review, switched on, after trials on three dates."""
    c = F.col("c_custkey")
    reviews = V.table(spark, d, "customer").select(c.alias("context"), (c % 5 != 0).alias("switched_on"), F.when(c % 7 == 0, "").otherwise(F.concat(F.lit("r"), c.cast("string"))).alias("review_id"))
    trials = V.table(spark, d, "orders").select(F.col("o_custkey").alias("context"), F.to_date("o_orderdate").alias("date"))
    return C.promotion(reviews, trials, "context")


@query(
    f"""WITH {V.RUNS}, {V.SCREENS}, j AS (SELECT f.id, f.at_us, f.app, f.win, r.end_us, r.state, r.id AS run, r.app AS r_app, r.win AS r_win FROM screens f ASOF LEFT JOIN runs r ON f.device = r.device AND f.at_us >= r.start_us)
    SELECT id, CASE WHEN run IS NULL OR at_us >= end_us THEN 'no_anchor' WHEN state NOT IN ('active', 'unattributed') THEN 'not_foreground' WHEN coalesce(app, '') <> coalesce(r_app, '') OR coalesce(win, '') <> coalesce(r_win, '') THEN 'metadata_conflict' WHEN run % 10 = 0 THEN 'support_barrier' ELSE 'ok' END AS reason FROM j"""
)
def persist_candidate(spark, d):
    """A hypothesis is kept only if its frame lies in observed foreground support of the same app and window."""
    runs = _runs(spark, d).withColumnsRenamed({"app": "r_app", "win": "r_win"}).withColumn("run", F.col("id"))
    f = asof(V.screens(spark, d).select("id", "device", "at_us", "app", "win"), runs, ["device"], "at_us", ["run", "state", "end_us", "r_app", "r_win"])
    plain = lambda c: F.coalesce(c, F.lit(""))
    rules = [
        ("no_anchor", F.col("run").isNull() | (F.col("at_us") >= F.col("end_us"))),
        ("not_foreground", ~F.col("state").isin("active", "unattributed")),
        ("metadata_conflict", (plain("app") != plain("r_app")) | (plain("win") != plain("r_win"))),
        ("support_barrier", F.col("run") % 10 == 0),
    ]
    return f.select("id", first_reason(rules).alias("reason"))


@query(OVERLAP.replace("WITH ", f"WITH {V.STRETCHES.partition('samples AS')[1]}{V.STRETCHES.partition('samples AS')[2]}, ", 1).replace(f"{V.SESSIONS}", V.SESSIONS.partition(", sessions AS")[1][2:] + V.SESSIONS.partition(", sessions AS")[2], 1) + ", ph AS (SELECT device, day, min(start_us) AS start_us, max(end_us) AS end_us, any_value(labels) AS label FROM n GROUP BY device, day, island) SELECT device, 'computer' AS lane, start_us, end_us, context AS label, 'session' AS status FROM stretches UNION ALL SELECT device, 'computer', start_us, end_us, 'Unknown', 'unknown' FROM segments WHERE state = 'unattributed' UNION ALL SELECT device, 'phone', start_us, end_us, label, 'phone' FROM ph")
def timeline_lanes(spark, d):
    """Sessions and unknown segments in one lane, pieces of overlapping phone sessions in another."""
    segs = _segs(spark, d)
    row = lambda df, lane, label, status: df.select("device", F.lit(lane).alias("lane"), "start_us", "end_us", label.alias("label"), F.lit(status).alias("status"))
    phone = I.overlap_partition(I.by_day(V.sessions(spark, d)), A.KEYS, "app")
    return row(A.behavior_sessions(segs), "computer", F.col("context"), "session").unionByName(row(segs.where("state = 'unattributed'"), "computer", F.lit("Unknown"), "unknown")).unionByName(row(phone, "phone", F.col("labels"), "phone"))


CODES = ("malformed", "keys", "version", "kind", "uncertainty", "evidence", "evidence", "text", "text", "text", "claims", "citation", "null_claim", "primary", "specific", "ok", "ok")


@query(f"SELECT conv_id * 1000 + turn AS id, {list(CODES)}[(conv_id * 7 + turn) % 17 + 1] AS code FROM conversations")
def validate_results(spark, d):
    """Model results as JSON, one in seventeen kinds of fault each, and the first rule that each breaks."""
    c = V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), ((F.col("conv_id") * 7 + F.col("turn")) % 17).alias("k"))
    k, one, other = F.col("k"), F.concat(F.lit("e"), F.col("id").cast("string")), F.concat(F.lit("n"), F.col("id").cast("string"))
    none = F.array().cast("array<string>")
    when = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    project = F.when(k == 8, "see www.x.org").when(k == 14, "Alpha").when(k % 2 == 0, "Alpha")
    project = F.when(k == 12, None).otherwise(project)
    claims = F.create_map(
        F.lit("activity_kind"), F.array(one), F.lit("project_candidate"), F.when(project.isNotNull() | (k == 12), F.array(one, other)).otherwise(none), F.when(k == 10, "other").otherwise("task_candidate"),
        F.when(k == 9, F.array(one)).otherwise(none), F.lit("visible_work"), F.when(k == 11, F.array(one, F.lit("x"))).when(k == 13, F.array(other)).otherwise(F.array(one)),
    )
    body = [
        when(2, "activity_result_v0", F.lit("activity_result_v1")).alias("version"), when(3, "dancing", F.lit("coding")).alias("activity_kind"), project.alias("project_candidate"), when(9, "report finished", F.lit(None).cast("string")).alias("task_candidate"),
        when(7, None, F.lit("edits a table")).alias("visible_work"), F.when(k == 5, none).when(k == 6, F.array(one, F.lit("zz"))).otherwise(F.array(one, other)).alias("evidence_ids"), claims.alias("claim_evidence"),
        F.when(k == 4, "sure").when(k == 14, "unclear").otherwise("partial").alias("uncertainty"),
    ]
    text = lambda *more: F.to_json(F.struct(*body, *more), {"ignoreNullFields": "false"})
    record = F.when(k == 0, "{broken").when(k == 1, text(F.lit(1).alias("more"))).otherwise(text())
    evidence = c.select("id", F.explode(F.array(F.struct(one.alias("evidence_id"), F.lit(True).alias("primary")), F.struct(other.alias("evidence_id"), F.lit(False).alias("primary")))).alias("e")).select("id", "e.*")
    return C.validate_results(c.select("id", record.alias("record")), evidence, "activity_result_v1")


@query(
    """WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[a-z0-9]{4,}')[1] AS w FROM conversations), a AS (SELECT *, CASE WHEN turn % 6 = 0 THEN 'none' WHEN turn % 6 = 1 THEN 'finished' WHEN turn % 6 = 2 THEN 'foreign' WHEN w IS NULL THEN 'foreign' ELSE 'ok' END AS k FROM w)
    SELECT conv_id, turn AS id, CASE WHEN k = 'ok' AND NOT list_contains({generic}, w) THEN w || ' project' ELSE 'Unclear' END AS topic, CASE WHEN k = 'none' THEN 'model_failed' WHEN k = 'ok' AND NOT list_contains({generic}, w) THEN 'model_inference' ELSE 'unclassified' END AS status FROM a""".replace("{generic}", str(list(T.GENERIC)))
)
def validate_batch(spark, d):
    """Topics that a model gave turns, each with a word as evidence: which stand, which don't, and which are missing."""
    c, t = V.table(spark, d, "conversations"), F.col("turn")
    word = F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0)), F.lit(0))
    topic = F.when(t % 6 == 1, F.concat(word, F.lit(" finished"))).when(t % 6 == 2, "zzyzx plan").otherwise(F.concat(F.coalesce(word, F.lit("zzyzx")), F.lit(" project")))
    answers = c.where("turn % 6 <> 0").select("conv_id", t.alias("id"), t.alias("ord"), topic.alias("topic"), F.coalesce(word, F.lit("zzyzx")).alias("word"))
    late = answers.select("conv_id", "id", (F.col("ord") + 1000).alias("ord"), F.lit("later topic").alias("topic"), F.lit("later").alias("word"))
    strange = answers.withColumn("id", F.col("id") + 5000)
    return C.batch_dispositions(c.select("conv_id", t.alias("id"), F.col("text").alias("source")), answers.unionByName(late).unionByName(strange), "conv_id")


PERIOD = f"""WITH {V.STRETCHES}, su AS (SELECT device, day, CAST(coalesce(sum(us) FILTER (us >= 1200000000), 0) AS BIGINT) AS sustained_us FROM stretches GROUP BY ALL), md AS (SELECT * FROM measures JOIN su USING (device, day))"""
TOTAL = "SELECT device, CAST(sum(us) AS BIGINT) AS us, CAST(sum(switches) AS BIGINT) AS switches, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(sustained_us) AS BIGINT) AS sustained_us, max(longest_us) AS longest_us, count(*) AS days, CASE WHEN sum(us) > 0 THEN CAST(floor(sum(switches)::DOUBLE * 36000000000.0::DOUBLE / sum(us)::DOUBLE + 0.5) AS BIGINT) END AS switches_per_hour_x10 FROM md GROUP BY device"


def _continuity(spark, d, since=None):
    s = _stretches(spark, d)
    if since is not None:
        s = s.join(s.groupBy("device").agg(F.max("day").alias("m")), "device").where(F.col("day") > F.col("m") - since).drop("m")
    sustained = s.groupBy(*A.KEYS).agg(F.sum(F.when(F.col("us") >= 1200 * SECOND, F.col("us")).otherwise(0)).alias("sustained_us"))
    return C.continuity(A.behavior_measures(s).join(sustained, A.KEYS), A.duration_histogram(s), ["device"])


@query(PERIOD + " " + TOTAL)
def aggregate_continuity(spark, d):
    """Behavior over all days that are there; the rate comes from the sums."""
    return _continuity(spark, d)[0]


@query(PERIOD.replace(", su AS", ", lst AS (SELECT device AS ld, max(day) AS m FROM stretches GROUP BY ALL), su AS").replace("md AS (SELECT * FROM measures JOIN su USING (device, day))", "md AS (SELECT * FROM measures JOIN su USING (device, day) JOIN lst ON ld = device WHERE day > m - 7)") + " " + TOTAL)
def week_behavior(spark, d):
    """The same over the last seven days of each device."""
    return _continuity(spark, d, 7)[0]


@query(PERIOD + ", b AS (SELECT device, CASE WHEN us < 120000000 THEN 0 WHEN us < 300000000 THEN 1 WHEN us < 900000000 THEN 2 WHEN us < 1800000000 THEN 3 ELSE 4 END AS bucket, count(*) AS sessions, sum(us) AS us FROM stretches GROUP BY ALL), sp AS (SELECT device, bucket FROM (SELECT DISTINCT device FROM stretches), (SELECT unnest(range(5)) AS bucket)) SELECT device, bucket, coalesce(sessions, 0) AS sessions, CAST(coalesce(us, 0) AS BIGINT) AS us FROM sp LEFT JOIN b USING (device, bucket)")
def continuity_histogram(spark, d):
    return _continuity(spark, d)[1]


SITES = f"""tb AS (SELECT event_id AS id, user_id % 4 AS device, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) AS start_us, 'h' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7)::VARCHAR AS site, event_type = 'view' AS focused FROM events WHERE event_type IN ('view', 'error')),
    lt AS (SELECT *, lead(start_us) OVER (PARTITION BY device, day ORDER BY start_us, id) AS end_us FROM tb)"""


@query(
    f"""WITH {V.SEGMENTS}, {SITES}, al AS (SELECT device, 'app' AS kind, app AS name, sum(end_us - start_us) AS us FROM runs WHERE app IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lt.device, 'site', site, sum(least(lt.end_us, s.end_us) - greatest(lt.start_us, s.start_us)) FROM lt JOIN segments s ON s.device = lt.device AND s.day = lt.day AND s.state = 'active' AND s.app = 'app1' AND s.start_us < lt.end_us AND lt.start_us < s.end_us WHERE focused AND lt.end_us > lt.start_us GROUP BY ALL
      UNION ALL SELECT device, 'phone', app, sum(end_us - start_us) FROM (SELECT id, device, start_us, start_us + dur_us AS end_us, 'a' || (k % 5)::VARCHAR AS app FROM samples WHERE dur_us > 0 AND dur_us <= 21600000000) GROUP BY ALL)
    SELECT device, kind, name, CAST(us AS BIGINT) AS us, row_number() OVER (PARTITION BY device, kind ORDER BY us DESC, name) AS rank FROM al"""
)
def apps_sites_period(spark, d):
    """Totals of apps, sites and phone apps over a period, each kind ranked."""
    us = F.sum(F.col("end_us") - F.col("start_us")).alias("us")
    apps = _runs(spark, d).where("app IS NOT NULL").groupBy("device", F.col("app").alias("name")).agg(us).withColumn("kind", F.lit("app"))
    sites = A.browser_overlap(V.tabs(spark, d), _segs(spark, d)).withColumnRenamed("site", "name").withColumn("kind", F.lit("site"))
    phone = V.sessions(spark, d).groupBy("device", F.col("app").alias("name")).agg(us).withColumn("kind", F.lit("phone"))
    return top_k(apps.unionByName(sites).unionByName(phone), ["device", "kind"], "us", "name").select("device", "kind", "name", "us", "rank")


@query(
    f"""WITH {FACTS}, ph AS (SELECT device, max(end_us) AS last_us FROM sessions WHERE id % 3 = 0 GROUP BY device) SELECT device, day, array_to_string(list_filter([CASE WHEN active_us % 10 = 0 THEN 'quality_failed' END, CASE WHEN unattributed_us > greatest(300000000, observed_us * 15 // 100) THEN 'unknown_high' END, CASE WHEN coalesce((day + 1) * 86400000000 - last_us >= 21600000000, true) THEN 'phone_stale' END,
    CASE WHEN observed_us < 14400000000 THEN 'coverage_low' END, CASE WHEN active_us + unattributed_us = 0 THEN 'no_foreground' END], lambda x: x IS NOT NULL), ',') AS codes FROM facts LEFT JOIN ph USING (device)"""
)
def alerts(spark, d):
    """What a day's reader must be told: failed checks, much unknown time, a stale phone, little coverage."""
    from spanloom.operators.rollup import day_alerts

    phone = V.sessions(spark, d).where("id % 3 = 0").groupBy("device").agg(F.max("end_us").alias("last_us"))
    f = _facts(spark, d).join(phone, "device", "left").withColumns({"failed": F.col("active_us") % 10 == 0, "phone_age_us": (F.col("day") + 1) * DAY - F.col("last_us")})
    return day_alerts(f)


NUM = "coalesce({c}::VARCHAR, 'null')"


@query(
    f"""WITH {FACTS} SELECT device, day, '{{"schema_version":1,"device":' || device::VARCHAR || ',"day":' || day::VARCHAR || ',"coverage":"' || coverage || '","computer":{{"identified_us":' || active_us::VARCHAR || ',"window_unknown_us":' || unattributed_us::VARCHAR || ',"unobserved_us":' || unobserved_us::VARCHAR
      || '}},"phone":{{"union_us":' || {NUM.format(c='session_union_us')} || '}},"behavior":{{"sessions":' || {NUM.format(c='stretches')} || ',"switches":' || {NUM.format(c='switches')} || ',"longest_us":' || {NUM.format(c='longest_us')} || '}}}}' AS document FROM facts"""
)
def review_export(spark, d):
    """One compact document a day: totals and measures, no titles and no sessions."""
    from spanloom.operators.rollup import review_document

    return _facts(spark, d).select("device", "day", review_document().alias("document"))
