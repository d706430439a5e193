"""Queries of evidence, labels, evaluation and period views."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.time import DAY, HOUR, MINUTE, SECOND
from spanloom.operators import activity as A
from spanloom.operators import evidence as E
from spanloom.operators import interval as I
from spanloom.plans.book import Book
from spanloom.plans.queries_activity import REVIEW, _review, _runs, _segs, _stretches
from spanloom.sources import adapters as V

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql

TAGS = "tags AS (SELECT doc_id AS id, 'q' || quality::VARCHAR || 't' || toxic::VARCHAR AS topic FROM labels)"


@query(f"WITH {V.FRAMES}, a AS (SELECT * FROM frames WHERE display = 'en'), m AS (SELECT device, at_us, at_us - 30000000 AS s, at_us + 30000000 AS e, max(at_us + 30000000) OVER (PARTITION BY device ORDER BY at_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a) SELECT device, count(*) AS anchors, count(DISTINCT at_us // 1800000000) AS slots, CAST(sum(e - greatest(s, coalesce(reach, s))) AS BIGINT) AS reach_us FROM m GROUP BY device")
def frame_reach(spark, d):
    return E.reach(V.frames(spark, d).where("display = 'en'"), 30 * SECOND, 30 * MINUTE)


@query(REVIEW + ", lb AS (SELECT device, start_us // 900000000 AS slot, min('L' || (k % 3)::VARCHAR) AS label FROM samples WHERE k % 6 = 1 GROUP BY ALL) SELECT rs.device, rs.slot, unknown_us, label, label IS NOT NULL AS confirmed FROM rs LEFT JOIN lb USING (device, slot) WHERE unknown_us >= 120000000")
def review_view(spark, d):
    """Slots to review with their current label."""
    lb = V.samples(spark, d).where("k % 6 = 1").groupBy("device", F.floor(F.col("start_us") / (15 * MINUTE)).alias("slot")).agg(F.min(F.concat(F.lit("L"), (F.col("k") % 3).cast("string"))).alias("label"))
    return _review(spark, d).join(lb, ["device", "slot"], "left").withColumn("confirmed", F.col("label").isNotNull())


@query(f"WITH {V.RECEIPTS}, n AS (SELECT night, sum(completed) AS ok, sum(elapsed_cs) AS cost FROM receipts GROUP BY night) SELECT night, CAST(least(250, CASE WHEN cost > 0 THEN 432000 * ok // cost ELSE 0 END) AS BIGINT) AS quota FROM n")
def seeded_trial_quota(spark, d):
    n = V.receipts(spark, d).groupBy("night").agg(F.sum("completed").alias("ok"), F.sum("elapsed_cs").alias("cost"))
    return n.select("night", F.expr("least(250, CASE WHEN cost > 0 THEN 432000 * ok div cost ELSE 0 END)").cast("long").alias("quota"))


@query(f"WITH {V.STRETCHES}, dd AS (SELECT DISTINCT device, day FROM segments), c AS (SELECT device, day, sum(us) AS us FROM stretches WHERE context = 'app1/w1' GROUP BY ALL) SELECT dd.device, dd.day, CAST(c.us AS BIGINT) AS us, c.us IS NULL AS absent FROM dd LEFT JOIN c USING (device, day)")
def context_by_day(spark, d):
    segs = _segs(spark, d)
    c = A.behavior_sessions(segs).where("context = 'app1/w1'").groupBy(*A.KEYS).agg(F.sum("us").alias("us"))
    return segs.select(*A.KEYS).distinct().join(c, A.KEYS, "left").withColumn("absent", F.col("us").isNull())


@query(f"WITH {V.STRETCHES}, a AS (SELECT device, day, sum(us) AS exact_us FROM stretches GROUP BY ALL), b AS (SELECT device, day, sum(sampled_us) AS compact_us FROM segments WHERE state = 'active' GROUP BY ALL) SELECT device, day, CASE WHEN exact_us = compact_us THEN 'exact' ELSE 'compact' END AS chosen, CAST(compact_us AS BIGINT) AS us FROM b LEFT JOIN a USING (device, day)")
def exact_context_choice(spark, d):
    """Exact sessions only where they reconcile with the day's total."""
    segs = _segs(spark, d)
    a = A.behavior_sessions(segs).groupBy(*A.KEYS).agg(F.sum("us").alias("exact_us"))
    b = segs.where("state = 'active'").groupBy(*A.KEYS).agg(F.sum("sampled_us").alias("us"))
    return b.join(a, A.KEYS, "left").select(*A.KEYS, F.when(F.col("exact_us") == F.col("us"), "exact").otherwise("compact").alias("chosen"), "us")


@query(f"WITH {V.STRETCHES}, l AS (SELECT * FROM stretches WHERE us >= 120000000), k AS (SELECT device, context FROM (SELECT device, context, sum(us) AS s FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY device ORDER BY s DESC, context) <= 3) SELECT l.device, l.day, l.context, l.start_us, l.us FROM l SEMI JOIN k ON k.device = l.device AND k.context = l.context")
def context_map(spark, d):
    from spanloom.operators.rank import top_k

    long = _stretches(spark, d).where(F.col("us") >= 120 * SECOND)
    top = top_k(long.groupBy("device", "context").agg(F.sum("us").alias("s")), ["device"], "s", "context", 3)
    return long.join(top.select("device", "context"), ["device", "context"], "left_semi").select("device", "day", "context", "start_us", "us")


@query(f"WITH {V.STRETCHES} SELECT device, start_us, end_us, context AS what, 'session' AS lane FROM stretches UNION ALL SELECT device, start_us, end_us, NULL, 'unknown' FROM segments WHERE state = 'unattributed'")
def activity_log(spark, d):
    segs = _segs(spark, d)
    a = A.behavior_sessions(segs).select("device", "start_us", "end_us", F.col("context").alias("what"), F.lit("session").alias("lane"))
    return a.unionByName(segs.where("state = 'unattributed'").select("device", "start_us", "end_us", F.lit(None).cast("string").alias("what"), F.lit("unknown").alias("lane")))


@query(f"WITH {V.RUNS}, h AS (SELECT DISTINCT device, state, unnest(range(start_us // 1800000000, (end_us - 1) // 1800000000 + 1)) AS b FROM runs) SELECT device, b AS half_hour FROM h WHERE state = 'active' INTERSECT SELECT device, b FROM h WHERE state = 'unattributed'")
def bins_intersection(spark, d):
    runs = _runs(spark, d)
    return I.half_hours(runs.where("state = 'active'"), ["device"]).intersect(I.half_hours(runs.where("state = 'unattributed'"), ["device"]))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT doc_id FROM labels")
def minus_selected(spark, d):
    return V.frames(spark, d).where("id % 3 <> 0").select("id").join(V.tags(spark, d).select("id"), "id", "left_anti").distinct()


@query("SELECT o_custkey % 20 AS repo, o_orderkey AS sha FROM orders WHERE o_custkey % 7 = 3 UNION SELECT o_custkey % 20, o_orderkey FROM orders WHERE o_custkey % 5 = 3")
def merge_author_committer(spark, d):
    c = V.commits(spark, d)
    return c.where("author = 3").union(c.where("committer = 3")).select("repo", "sha").distinct()


@query(f"WITH {TAGS}, c AS (SELECT id, topic, 'checked' AS status FROM tags UNION ALL SELECT doc_id, 'q9t9', 'propagated' FROM documents WHERE doc_id % 17 = 0) SELECT status, topic, count(*) AS rows FROM c GROUP BY ALL")
def supported_union(spark, d):
    p = V.frames(spark, d).where("id % 17 = 0").select("id", F.lit("q9t9").alias("topic"), F.lit("propagated").alias("status"))
    return V.tags(spark, d).withColumn("status", F.lit("checked")).unionByName(p).groupBy("status", "topic").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderkey AS id, sha256('{\"custkey\":' || o_custkey::VARCHAR || ',\"status\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def canonical_fingerprint(spark, d):
    doc = F.to_json(F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status")), {"ignoreNullFields": "false"})
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(doc, 256).alias("fingerprint"))


@query(f"WITH {V.ANNOTATIONS}, x AS (SELECT path % 50 AS session, status = 'incomplete' AS open, CAST(elapsed_s AS BIGINT) AS s FROM annotations WHERE n = 1) SELECT session, CAST(coalesce(sum(s) FILTER (NOT open), 0) AS BIGINT) AS measured_s, count(*) FILTER (open) AS interrupted, CASE WHEN bool_or(open) THEN NULL ELSE CAST(sum(s) AS BIGINT) END AS total_s, CAST(sum(CASE WHEN open THEN 60 ELSE s END) AS BIGINT) AS upper_s FROM x GROUP BY session")
def session_cost(spark, d):
    x = V.annotations(spark, d).where("n = 1").select((F.col("path") % 50).alias("session"), (F.col("status") == "incomplete").alias("open"), F.col("elapsed_s").cast("long").alias("s"))
    s, o = F.col("s"), F.col("open")
    return x.groupBy("session").agg(F.sum(F.when(~o, s).otherwise(0)).alias("measured_s"), F.count_if(o).alias("interrupted"), F.when(F.bool_or(o), None).otherwise(F.sum(s)).alias("total_s"), F.sum(F.when(o, 60).otherwise(s)).alias("upper_s"))


__all__ = ["DAY", "HOUR", "QUERIES", "SQL"]
