"""Queries of trials and telemetry: cohorts, splits, reviews, metrics by variant, exports, accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.time import DAY, MINUTE, SECOND
from spanloom.operators import activity as A
from spanloom.operators import context as C
from spanloom.operators import quality as Q
from spanloom.operators import trial as E
from spanloom.operators.evidence import first_reason
from spanloom.operators.interval import by_day
from spanloom.plans.book import Book
from spanloom.plans.queries_activity import FACTS, _runs
from spanloom.plans.queries_context import MARKS, NEAREST, SLOTS, TOPICS, _marks, _topics
from spanloom.plans.queries_text import _q
from spanloom.sources import adapters as V
from spanloom.sources.scratch import scratch, written

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql

# Three variants answer examples; every line of an order is an answer, those of one example and variant are one.
EXAMPLES = """ln AS (SELECT (l_linenumber - 1) % 3 + 1 AS variant, l_orderkey * 10 + (l_linenumber - 1) // 3 AS example, l_orderkey, l_quantity AS q, l_returnflag AS f, l_linestatus AS s, l_suppkey FROM lineitem),
    res AS (SELECT CAST(variant AS BIGINT) AS variant, example, max(q) <> 13 AS attempted, CASE WHEN max(s) = 'O' AND min(q) % 5 = 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN min(q) > 8 THEN min(f) END AS guess, variant <> 3 AS raw_available, max(q) % 17 = 0 AS privacy, sum(q) AS elapsed FROM ln GROUP BY variant, example),
    ex AS (SELECT DISTINCT example, l_orderkey // 7 AS episode, l_orderkey % 48 AS bin, CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS truth FROM ln)"""


def _lines(spark, d):
    n = F.col("l_linenumber") - 1
    return V.table(spark, d, "lineitem").select((n % 3 + 1).cast("long").alias("variant"), (F.col("l_orderkey") * 10 + F.floor(n / 3)).alias("example"), "l_orderkey", F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_suppkey")


def _results(spark, d):
    status = F.when((F.max("s") == "O") & (F.min("q") % 5 == 0), "failed").otherwise("complete")
    r = _lines(spark, d).groupBy("variant", "example").agg((F.max("q") != 13).alias("attempted"), status.alias("status"), F.when(F.min("q") > 8, F.min("f")).alias("guess"), (F.max("q") % 17 == 0).alias("privacy"), F.sum("q").alias("elapsed"))
    return r.withColumn("raw_available", F.col("variant") != 3)


def _examples(spark, d):
    k = F.col("l_orderkey")
    truth = F.when(k % 4 == 1, "A").when(k % 4 == 2, "N").when(k % 4 == 3, "R")
    return _lines(spark, d).select("example", F.floor(k / 7).alias("episode"), (k % 48).alias("bin"), truth.alias("truth")).distinct()


@query(
    f"""WITH {EXAMPLES}, m AS (SELECT v.variant, ex.*, r.attempted, r.status, r.guess, r.raw_available, r.privacy, r.elapsed FROM ex CROSS JOIN (SELECT unnest([1, 2, 3, 4])::BIGINT AS variant) v LEFT JOIN res r ON r.example = ex.example AND r.variant = v.variant)
    SELECT variant, count(*) AS selected, count(*) FILTER (attempted) AS attempted, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS pending, count(*) FILTER (status = 'complete' AND guess IS NOT DISTINCT FROM truth) AS correct,
    CASE WHEN count(*) FILTER (status = 'complete' AND guess IS NOT NULL) > 0 THEN count(*) FILTER (status = 'complete' AND guess = truth) * 1000000 // count(*) FILTER (status = 'complete' AND guess IS NOT NULL) END AS precision_ppm,
    CASE WHEN count(truth) > 0 THEN count(*) FILTER (status = 'complete' AND guess = truth) * 1000000 // count(truth) END AS recall_ppm, CASE WHEN count(*) > count(truth) THEN count(*) FILTER (status = 'complete' AND guess IS NULL AND truth IS NULL) * 1000000 // (count(*) - count(truth)) END AS abstention_ppm,
    count(*) FILTER (status = 'complete' AND guess IS NULL AND truth IS NULL) AS right_abstentions, CASE WHEN count(*) FILTER (attempted AND raw_available) > 0 THEN count(*) FILTER (attempted AND privacy) END AS privacy_flags, sum(elapsed) FILTER (attempted) AS total_s, median(elapsed) FILTER (status = 'complete') AS median_s,
    count(DISTINCT episode) FILTER (status = 'complete') AS episodes, count(DISTINCT bin) FILTER (status = 'complete') AS bins FROM m GROUP BY variant"""
)
def variant_metrics(spark, d):
    """Metrics of three variants, and of a fourth that was never run, over all examples."""
    return E.variant_report(_examples(spark, d), _results(spark, d), [1, 2, 3, 4])


@query(
    f"""WITH {EXAMPLES}, r AS (SELECT variant, example % 2 AS round, CAST(sum(elapsed) AS BIGINT) AS cost, count(*) FILTER (status = 'complete') AS correct, count(*) FILTER (privacy) AS critical FROM res GROUP BY variant, example % 2),
    f AS (SELECT r.variant, bool_and(r.cost * 100 <= b.cost * 85 AND r.correct >= b.correct AND r.critical = 0) AS ok, sum(r.cost) AS total FROM r JOIN r b ON b.variant = 1 AND b.round = r.round WHERE r.variant <> 1 GROUP BY r.variant)
    SELECT coalesce((SELECT arg_min(variant, (total, variant)) FROM f WHERE ok), 1) AS variant, CAST(coalesce((SELECT min(total) FROM f WHERE ok), (SELECT sum(cost) FROM r WHERE variant = 1)) AS BIGINT) AS total"""
)
def nominate_runtime(spark, d):
    """The variant that is 15 per cent faster than the first in both rounds and never worse."""
    r = _results(spark, d).groupBy("variant", (F.col("example") % 2).alias("round"))
    return E.nominate_variant(r.agg(F.sum("elapsed").cast("long").alias("cost"), F.count_if(F.col("status") == "complete").alias("correct"), F.count_if("privacy").alias("critical")), 1)


@query(
    f"""WITH {EXAMPLES}, ev AS (SELECT variant, example, list_sort(list_distinct(list(l_suppkey % 4))) AS evidence, min(f) AS a, min(s) AS b FROM ln GROUP BY ALL), g AS (SELECT example, CASE WHEN example % 5 <> 0 THEN a END AS a, b, evidence FROM ev WHERE variant = 1), x AS (SELECT example, CASE WHEN example % 3 <> 0 THEN a END AS a, b, evidence FROM ev WHERE variant = 2),
    m AS (SELECT g.*, x.a AS a2, x.b AS b2, x.evidence AS e2 FROM g LEFT JOIN x USING (example))
    SELECT count(*) AS n, count(*) FILTER (a IS NOT DISTINCT FROM a2 AND e2 IS NOT NULL) AS field_a, count(*) FILTER (b = b2) AS field_b, count(*) FILTER (a IS NOT DISTINCT FROM a2 AND b = b2) AS joint, count(*) FILTER (evidence = e2) AS evidence, count(*) FILTER (e2 IS NOT NULL AND a2 IS NULL AND a IS NULL) AS right_abstentions, count(*) FILTER (e2 IS NOT NULL AND a2 IS NULL AND a IS NOT NULL) AS missed FROM m"""
)
def score_generations(spark, d):
    per = _lines(spark, d).groupBy("variant", "example").agg(F.min("f").alias("a"), F.min("s").alias("b"), F.collect_set(F.col("l_suppkey") % 4).alias("evidence"))
    some = lambda v, k: per.where(F.col("variant") == v).select("example", F.when(F.col("example") % k != 0, F.col("a")).alias("a"), "b", "evidence")
    return E.generation_scores(some(1, 5), some(2, 3), ["a", "b"])


@query(
    f"""WITH {EXAMPLES}, gr AS (SELECT example, variant, CASE WHEN example % 50 = 7 THEN NULL WHEN example % 31 = 3 THEN 'changed' ELSE coalesce(guess, '-') END AS output, status = 'complete' AND elapsed % 3 <> 0 OR example % 97 = 5 AS p, status = 'complete' AND elapsed % 5 <> 0 AS t, status = 'complete' AND elapsed % 7 <> 0 AS e, status = 'complete' AND elapsed % 11 <> 0 AS u, privacy AS leak, elapsed % 23 = 0 AS uc, CAST(elapsed AS BIGINT) % 3 AS n FROM res),
    m AS (SELECT r.variant, r.status, gr.*, gr.output IS NOT NULL AND gr.output = coalesce(r.guess, '-') AS whole FROM res r LEFT JOIN gr ON gr.example = r.example AND gr.variant = r.variant), w AS (SELECT * EXCLUDE (variant_1), whole AND status <> 'complete' AND (p OR t OR e OR u) AS invalid FROM m), o AS (SELECT *, whole AND NOT invalid AS ok FROM w)
    SELECT variant, count(*) AS selected, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (ok) AS reviewed, count(*) FILTER (invalid) AS invalid, bool_and(ok) AS whole, count(*) FILTER (ok AND status = 'complete' AND p AND t AND e) AS joint_correct, count(*) FILTER (ok AND NOT e) AS evidence_errors, count(*) FILTER (ok AND NOT u) AS uncertainty_errors,
      count(*) FILTER (ok AND leak) AS privacy_leaks, count(*) FILTER (ok AND uc) AS completion_claims, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS unsupported_claims FROM o GROUP BY variant"""
)
def assessment_join(spark, d):
    """Results with their grades: totals by variant, and whether the review is whole and for these very outputs."""
    r = _results(spark, d).withColumn("output", F.coalesce("guess", F.lit("-")))
    k, t, done = F.col("example"), F.col("elapsed"), F.col("status") == "complete"
    g = r.where("example % 50 <> 7").select(
        "example", "variant", F.when(k % 31 == 3, "changed").otherwise(F.col("output")).alias("output"), (done & (t % 3 != 0) | (k % 97 == 5)).alias("project_correct"), (done & (t % 5 != 0)).alias("task_correct"), (done & (t % 7 != 0)).alias("evidence_supported"),
        (done & (t % 11 != 0)).alias("uncertainty_appropriate"), F.col("privacy").alias("privacy_leak"), (t % 23 == 0).alias("unsupported_completion"), (t.cast("long") % 3).alias("unsupported_claims"),
    )
    return E.assessment_totals(r.select("example", "variant", "status", "output"), g)


@query(
    f"""WITH {V.ANNOTATIONS}, t AS (SELECT CASE WHEN n = 7 THEN NULL WHEN n % 3 = 0 THEN 'vision_startup' ELSE 'vision' END AS stage, 'e' || model::VARCHAR AS engine, 'v' || (path % 2)::VARCHAR AS variant, 'm' || (path % 3)::VARCHAR || '|p' || (n % 2)::VARCHAR AS identity,
      CASE WHEN path % 13 = 0 THEN NULL WHEN status = 'incomplete' AND path % 5 = 0 THEN 'running' WHEN status = 'incomplete' AND path % 5 = 1 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN path % 11 = 0 THEN NULL WHEN n % 3 = 0 THEN 'not_applicable' WHEN status = 'filtered' THEN 'refused' ELSE 'complete' END AS result_status,
      CASE WHEN path % 17 = 0 THEN NULL WHEN path % 19 = 0 THEN NULL ELSE elapsed_s END AS process_s, CASE WHEN path % 23 = 0 AND n < 3 THEN NULL ELSE elapsed_s * 2 END AS elapsed_s, CASE WHEN path % 7 = 0 THEN NULL ELSE 8 END AS cores, elapsed_s AS base, n FROM annotations),
    g AS (SELECT *, concat_ws(':', coalesce(stage, 'unknown'), engine, variant, substr(sha256(identity), 1, 16)) AS grp FROM t), s AS (SELECT grp, cores, base * 4 + i AS cpu, CASE WHEN i = 1 THEN NULL ELSE base END AS gpu FROM (SELECT *, unnest(range(n % 3)) AS i FROM g)),
    l AS (SELECT grp, CAST(floor(avg(CASE WHEN cores > 0 THEN cpu / cores END) * 1000 + 0.5) AS BIGINT) AS cpu_milli, CAST(floor(avg(gpu) * 1000 + 0.5) AS BIGINT) AS gpu_milli FROM s GROUP BY grp)
    SELECT g.grp AS "group", count(*) AS attempts, count(*) FILTER (status = 'complete' AND result_status = 'complete') AS complete, count(*) FILTER (status = 'complete') AS process_complete, count(*) FILTER (status = 'running') AS pending, count(*) FILTER (status = 'failed') AS process_failed,
      count(*) FILTER (status = 'complete' AND result_status <> 'complete' AND NOT (coalesce(stage, '') = 'vision_startup' AND result_status = 'not_applicable')) AS decode_failed, count(*) FILTER (status = 'complete' AND stage = 'vision_startup' AND result_status = 'not_applicable') AS not_applicable, count(*) FILTER (status = 'complete' AND result_status IS NULL) AS decode_unknown,
      count(*) FILTER (status IS NULL) AS process_unknown, median(process_s) FILTER (status = 'complete' AND result_status = 'complete') AS median_s, CAST(floor(avg(process_s) FILTER (status = 'complete' AND result_status = 'complete') * 1000 + 0.5) AS BIGINT) AS mean_milli, coalesce(sum(elapsed_s), 0) AS known_s,
      any_value(cpu_milli) AS cpu_milli, any_value(gpu_milli) AS gpu_milli, CASE WHEN count(*) = count(elapsed_s) THEN sum(elapsed_s) END AS total_s, count(*) - count(elapsed_s) AS unknown_elapsed FROM g LEFT JOIN l ON l.grp = g.grp GROUP BY g.grp"""
)
def telemetry_groups(spark, d):
    """Attempts by stage, engine, variant and identity: dispositions, times, load; a total only where nothing is unknown."""
    p, n, e, st = F.col("path"), F.col("n"), F.col("base"), F.col("st")
    status = F.when(p % 13 == 0, None).when((st == "incomplete") & (p % 5 == 0), "running").when((st == "incomplete") & (p % 5 == 1), "failed").otherwise("complete")
    result = F.when(p % 11 == 0, None).when(n % 3 == 0, "not_applicable").when(st == "filtered", "refused").otherwise("complete")
    measures = F.transform(F.sequence(F.lit(0).cast("long"), n % 3), lambda i: F.struct((e * 4 + i).alias("cpu"), F.when(i != 1, e).alias("gpu")))
    t = V.annotations(spark, d).withColumnsRenamed({"elapsed_s": "base", "status": "st"}).select(
        F.when(n == 7, None).when(n % 3 == 0, "vision_startup").otherwise("vision").alias("stage"), F.concat(F.lit("e"), F.col("model").cast("string")).alias("engine"), F.concat(F.lit("v"), (p % 2).cast("string")).alias("variant"),
        F.concat(F.lit("m"), (p % 3).cast("string"), F.lit("|p"), (n % 2).cast("string")).alias("identity"), status.alias("status"), result.alias("result_status"), F.when(p % 17 == 0, None).when(p % 19 == 0, -1.0).otherwise(e).alias("process_s"),
        F.when((p % 23 == 0) & (n < 3), F.lit(float("nan"))).otherwise(e * 2).alias("elapsed_s"), F.when(p % 7 != 0, 8).alias("cores"), F.slice(measures, 1, (n % 3).cast("int")).alias("samples"),
    )
    milli = lambda c, name: F.floor(F.col(c) * 1000 + 0.5).alias(name)
    kept = ["group", "attempts", "complete", "process_complete", "pending", "process_failed", "decode_failed", "not_applicable", "decode_unknown", "process_unknown", "median_s", "known_s", "total_s", "unknown_elapsed"]
    return E.telemetry_groups(t).select(*kept, milli("mean_s", "mean_milli"), milli("cpu_percent", "cpu_milli"), milli("gpu_percent", "gpu_milli"))


NOTES = "CASE path % 10 WHEN 0 THEN 'Unclear view' WHEN 1 THEN 'finished the report' WHEN 2 THEN 'mail to a@b.co' WHEN 3 THEN 'order 1234567' WHEN 4 THEN 'see https://x.y/z' ELSE 'a window' END"


@query(
    f"""WITH {V.ANNOTATIONS}, c AS (SELECT *, {NOTES} AS caption FROM annotations) SELECT model, count(*) AS n, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'filtered') AS filtered,
    median(elapsed_s) FILTER (status = 'complete') AS median_s, quantile_disc(elapsed_s, 0.9) FILTER (status = 'complete') AS p90_s, count(*) FILTER (status = 'complete' AND path % 10 = 0) AS unclear, count(*) FILTER (status = 'complete' AND path % 10 = 1) AS claims_done, count(*) FILTER (status = 'complete' AND path % 10 IN (2, 3, 4)) AS identifiers FROM c GROUP BY model"""
)
def annotation_quality(spark, d):
    """By model: statuses, times, and lexical flags of what it wrote."""
    p = F.col("path")
    note = F.when(p % 10 == 0, "Unclear view").when(p % 10 == 1, "finished the report").when(p % 10 == 2, "mail to a@b.co").when(p % 10 == 3, "order 1234567").when(p % 10 == 4, "see https://x.y/z").otherwise("a window")
    return E.caption_quality(V.annotations(spark, d).withColumn("caption", note))


HASHES = """em AS (SELECT vec_id AS id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)::INTEGER) ELSE 0::BIGINT END))::BIGINT + CASE WHEN embedding[64] > 0 THEN -9223372036854775807 - 1 ELSE 0 END AS code FROM embeddings),
    hs AS (SELECT id * 3 AS id, id % 3 AS ord, code FROM em UNION ALL SELECT id * 3 + 1, (id + 1) % 3, xor(code, (1::BIGINT << (id % 7)::INTEGER) - 1) FROM em UNION ALL SELECT id * 3 + 2, (id + 2) % 3, xor(code, ((1::BIGINT << (id % 6)::INTEGER) - 1) << 20) FROM em),
    ho AS (SELECT *, row_number() OVER (ORDER BY ord, id) AS r FROM hs)"""


@query(
    f"""WITH RECURSIVE {HASHES}, g AS (SELECT r, id, true AS kept, [code] AS seen FROM ho WHERE r = 1 UNION ALL SELECT r, id, ok, CASE WHEN ok THEN list_append(seen, code) ELSE seen END FROM (SELECT ho.r, ho.id, ho.code, g.seen, len(list_filter(g.seen, lambda c: bit_count(xor(c, ho.code)) <= 4)) = 0 AS ok FROM g JOIN ho ON ho.r = g.r + 1)) SELECT id, kept FROM g"""
)
def near_dup_hash(spark, d):
    """64-bit difference hashes of vectors and of slightly changed copies: in order of splits, a row within 4 bits of a
    kept one goes."""
    bits = [F.when(F.element_at("embedding", i) > 0, F.lit(1 << (i - 1) if i < 64 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(1, 65)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), code.alias("code"))
    i, c = F.col("id"), F.col("code")
    low = lambda k: F.expr(f"shiftleft(1L, cast(id % {k} as int)) - 1")
    copies = e.select((i * 3 + 1).alias("id"), ((i + 1) % 3).alias("ord"), c.bitwiseXOR(low(7)).alias("code")).unionByName(e.select((i * 3 + 2).alias("id"), ((i + 2) % 3).alias("ord"), c.bitwiseXOR(F.shiftleft(low(6), 20)).alias("code")))
    return E.greedy_exclusion(e.select((i * 3).alias("id"), (i % 3).alias("ord"), "code").unionByName(copies)).select("id", "kept")


GROUPS = f"""{V.FRAMES}, nf AS (SELECT id, 'e' || (id // 3)::VARCHAR || '/' || (id % 3 // 2)::VARCHAR AS k FROM frames UNION ALL SELECT id, 'i' || md5(text) FROM frames WHERE text IS NOT NULL UNION ALL SELECT id, 'n' || left(lower(text), 60) FROM frames WHERE text IS NOT NULL),
    eg AS (SELECT DISTINCT a.id AS a, f.first AS b FROM nf a JOIN (SELECT k, min(id) AS first FROM nf GROUP BY k) f USING (k) WHERE a.id <> f.first), ed AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg),
    rc AS (SELECT id AS node, id AS seen FROM frames UNION SELECT ed.b, rc.seen FROM rc JOIN ed ON ed.a = rc.node), cg AS (SELECT node AS id, min(seen) AS grp FROM rc GROUP BY node)"""


def _grouped(spark, d):
    """Frames by episode, by equal text and by equal beginning of it."""
    i = F.col("id")
    f = V.frames(spark, d).select("id", F.concat(F.floor(i / 3).cast("string"), F.lit("/"), F.floor(i % 3 / 2).cast("string")).alias("episode"), F.md5("text").alias("image"), F.left(F.lower("text"), F.lit(60)).alias("near"))
    return E.whole_groups(f, ["episode", "image", "near"])


#: Sums of whole groups: parts are 1, 2, 4, ... groups of a size, the smallest size first; `first` has the part that first
#: reaches a sum, and `back` walks from the largest sum down.
FILL = f"""WITH RECURSIVE {GROUPS}, tg AS (SELECT count(*) * 2 // 10 AS t FROM cg), sz AS (SELECT grp, count(*) AS n FROM cg GROUP BY grp HAVING count(*) <= (SELECT t FROM tg)), hi AS (SELECT n, count(*) AS c FROM sz GROUP BY n),
    pl AS (SELECT n, unnest(list_concat(list_transform(range(0, CAST(floor(log2(c + 1)) AS BIGINT)), lambda j: (1::BIGINT << j::INTEGER)), CASE WHEN c + 1 > (1::BIGINT << floor(log2(c + 1))::INTEGER) THEN [c + 1 - (1::BIGINT << floor(log2(c + 1))::INTEGER)] ELSE []::BIGINT[] END)) AS k, unnest(range(0, 99)[: CAST(floor(log2(c + 1)) AS BIGINT) + CASE WHEN c + 1 > (1::BIGINT << floor(log2(c + 1))::INTEGER) THEN 1 ELSE 0 END]) AS j FROM hi),
    pt AS (SELECT n, k, n * k AS w, row_number() OVER (ORDER BY n, j) AS i FROM pl),
    re AS (SELECT 0::BIGINT AS i, 0::BIGINT AS s UNION SELECT re.i + 1, unnest([s, s + w]) AS s FROM re JOIN pt ON pt.i = re.i + 1),
    fr AS (SELECT s, min(i) AS i FROM re, tg WHERE s <= t GROUP BY s),
    back AS (SELECT s, i FROM fr WHERE s = (SELECT max(s) FROM fr) UNION ALL SELECT f.s, f.i FROM back JOIN pt ON pt.i = back.i JOIN fr f ON f.s = back.s - pt.w),
    plan AS (SELECT n, sum(k) AS k FROM back JOIN pt USING (i) GROUP BY n),
    hd AS (SELECT grp FROM (SELECT grp, n, row_number() OVER (PARTITION BY n ORDER BY md5(grp::VARCHAR), grp) AS place FROM sz) JOIN plan USING (n) WHERE place <= k)"""


@query(FILL + ' SELECT cg.id, grp AS "group", hd.grp IS NOT NULL AS held FROM cg LEFT JOIN hd USING (grp)')
def group_split(spark, d):
    """A fifth of all frames held out, as exactly as whole transitive groups of episode, image and near image allow."""
    return E.hold_out(_grouped(spark, d), 0.2).select("id", "group", "held")


COHORT = f"""{V.SCREENS}, rn AS (SELECT s.id, s.device, s.at_us, s.at_us // 1800000000 AS bin, s.id // 5 AS episode, 60 - s.id % 4 * 10 AS seconds, CASE WHEN s.id % 23 = 0 THEN 'duplicate_observation' WHEN status <> 'complete' THEN 'ocr_unavailable' WHEN regexp_matches(concat_ws(' ', app, win, CASE WHEN id % 13 = 0 THEN 'bank account' ELSE text END), {_q(T.SENSITIVE)}) THEN 'sensitive_filtered' WHEN id % 17 = 0 THEN 'missing_or_invalid_image'
      WHEN id % 6 = 0 THEN 'no_foreground_anchor' WHEN app IS NULL THEN 'collector_metadata_conflict' WHEN (id // 5) % 11 = 0 THEN 'support_barrier' ELSE 'ok' END AS reason FROM screens s),
    t1 AS (SELECT *, row_number() OVER (PARTITION BY device, bin, episode ORDER BY seconds DESC, id) AS turn FROM rn WHERE reason = 'ok'), t2 AS (SELECT *, row_number() OVER (PARTITION BY device, bin ORDER BY turn, seconds DESC, id) AS within FROM t1),
    co AS (SELECT device, id, bin, episode, at_us, seconds, row_number() OVER (PARTITION BY device ORDER BY within, bin) AS rank FROM t2 QUALIFY rank <= 40)"""


def _frames_for_trial(spark, d):
    s, i = V.screens(spark, d), F.col("id")
    text = F.when(i % 13 == 0, "bank account").otherwise(F.col("text"))
    rules = [
        ("duplicate_observation", i % 23 == 0), ("ocr_unavailable", F.col("status") != "complete"), ("sensitive_filtered", T.is_sensitive(F.col("app"), F.col("win"), text)), ("missing_or_invalid_image", i % 17 == 0),
        ("no_foreground_anchor", i % 6 == 0), ("collector_metadata_conflict", F.col("app").isNull()), ("support_barrier", F.floor(i / 5) % 11 == 0),
    ]
    return s.select("id", "device", "at_us", F.floor(F.col("at_us") / (30 * MINUTE)).alias("bin"), F.floor(i / 5).alias("episode"), (60 - i % 4 * 10).alias("seconds"), first_reason(rules).alias("reason"))


@query(f"WITH {COHORT} SELECT device, id, bin, episode, rank FROM co")
def cohort_sample(spark, d):
    """Up to forty frames of a device for a trial: bins take turns, different episodes first."""
    return E.cohort(_frames_for_trial(spark, d), F.col("reason"), "device", 40)


@query(f"WITH {COHORT} SELECT device, reason, count(*) AS frames FROM rn GROUP BY ALL")
def cohort_exclusions(spark, d):
    return _frames_for_trial(spark, d).groupBy("device", "reason").agg(F.count(F.lit(1)).alias("frames"))


@query(f"WITH {COHORT} SELECT device, count(*) AS selected, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', id, bin, episode)), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM co GROUP BY device")
def cohort_digest(spark, d):
    """A digest that freezes each cohort."""
    c = E.cohort(_frames_for_trial(spark, d), F.col("reason"), "device", 40)
    piece = F.conv(F.substr(F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in ("id", "bin", "episode")])), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return c.groupBy("device").agg(F.count(F.lit(1)).alias("selected"), F.sum(piece).alias("digest"))


@query(
    f"""WITH {COHORT}, rs AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'complete' WHEN toxic = 1 THEN 'running' ELSE 'failed' END AS status, doc_id % 3 <> 0 AS claims FROM labels), m AS (SELECT co.*, at_us - 30000000 AS s, at_us + seconds * 1000000 - 30000000 AS e, status, claims FROM co LEFT JOIN rs USING (id)),
    un AS (SELECT device, CAST(sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS BIGINT) AS support_us FROM (SELECT *, max(e) OVER (PARTITION BY device ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM m WHERE status = 'complete') GROUP BY device),
    uc AS (SELECT device, CAST(sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS BIGINT) AS claimed_us FROM (SELECT *, max(e) OVER (PARTITION BY device ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM m WHERE status = 'complete' AND claims) GROUP BY device),
    db AS (SELECT DISTINCT device, bin FROM m WHERE status = 'complete'), el AS (SELECT device, count(db.bin) * 1000000 // count(*) AS eligible_ppm FROM (SELECT DISTINCT device, bin FROM rn WHERE reason = 'ok') LEFT JOIN db USING (device, bin) GROUP BY device),
    oc AS (SELECT device, count(db.bin) * 1000000 // count(*) AS observed_ppm FROM (SELECT DISTINCT device, bin FROM rn) LEFT JOIN db USING (device, bin) GROUP BY device)
    SELECT device, count(*) AS selected, count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL OR status = 'running') AS pending, count(DISTINCT episode) FILTER (status = 'complete') AS episodes,
      coalesce(any_value(support_us), 0) AS support_us, coalesce(any_value(claimed_us), 0) AS claimed_us, any_value(eligible_ppm) AS eligible_ppm, any_value(observed_ppm) AS observed_ppm FROM m LEFT JOIN un USING (device) LEFT JOIN uc USING (device) LEFT JOIN el USING (device) LEFT JOIN oc USING (device) GROUP BY device"""
)
def cohort_coverage(spark, d):
    """What of the frozen cohorts was described: counts, bins, and the union of what frames support."""
    f = _frames_for_trial(spark, d)
    at = f.select("id", (F.col("at_us") - 30 * SECOND).alias("start_us"), (F.col("at_us") + F.col("seconds") * SECOND - 30 * SECOND).alias("end_us"))
    chosen = E.cohort(f, F.col("reason"), "device", 40).join(at, "id")
    status = F.when(F.col("quality") == 1, "complete").when(F.col("toxic") == 1, "running").otherwise("failed")
    results = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), status.alias("status"), (F.col("doc_id") % 3 != 0).alias("claims"))
    return E.coverage(chosen, results, f.where("reason = 'ok'"), f, "device")


TRAINING = """ex2 AS (SELECT d.doc_id AS id, CASE d.doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, CASE WHEN l.doc_id IS NOT NULL THEN '{"quality":' || quality::VARCHAR || ',"toxic":' || toxic::VARCHAR || '}' END AS answer, 'Describe frame ' || d.doc_id::VARCHAR || ' of ' || source AS prompt, d.doc_id % 7 = 0 AS excluded FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    tl AS (SELECT split, CASE WHEN split = 'test' THEN 'sealed' ELSE 'export' END AS folder, '{"id":' || id::VARCHAR || ',"split":"' || split || '","source_class":"real","messages":[{"role":"user","content":"' || prompt || '"},{"role":"assistant","content":"' || replace(answer, '"', '\\"') || '"}]}' AS line, id FROM ex2 WHERE answer IS NOT NULL AND NOT excluded)"""


def _training(spark, d):
    i = F.col("doc_id")
    l = V.table(spark, d, "labels").select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("answer"))
    e = V.table(spark, d, "documents").join(l, "doc_id", "left")
    return e.select(i.alias("id"), F.when(i % 5 == 0, "test").when(i % 5 == 1, "validation").otherwise("train").alias("split"), "answer", F.concat(F.lit("Describe frame "), i.cast("string"), F.lit(" of "), "source").alias("prompt"), (i % 7 == 0).alias("excluded"), F.lit("real").alias("source_class"))


@query(f"WITH {TRAINING} SELECT id, split, folder, line FROM tl")
def training_lines(spark, d):
    return E.training_lines(_training(spark, d))


@query(f"WITH {TRAINING} SELECT folder, split, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM tl GROUP BY ALL")
def export_training(spark, d):
    """Training lines as they were written, test rows in a folder of their own: counts and digests."""
    return E.export_training(_training(spark, d), scratch(spark))


DRIFT = {
    "observed_us": "observed_us + CASE WHEN day % 7 = 1 AND device = 0 THEN 1000000 ELSE 0 END",
    "unobserved_us": "unobserved_us - CASE WHEN day % 11 = 2 THEN 30000 ELSE 0 END",
    "sessions_declared": "sessions_declared + CASE WHEN day % 5 = 3 THEN 1 ELSE 0 END",
    "status_frames": "status_frames - CASE WHEN frames > 3 THEN 1 ELSE 0 END",
    "topic_us": "topic_us + CASE WHEN day % 13 = 4 THEN 200000 ELSE 50000 END",
    "app_us": "app_us * CASE WHEN day % 9 = 5 THEN 3 ELSE 1 END",
    "longest_us": "longest_us + CASE WHEN day % 17 = 6 THEN 86400000000 ELSE 0 END",
    "suggested_us": "suggested_us + CASE WHEN day % 19 = 7 THEN 86400000000 ELSE 0 END",
    "distribution_sessions": "distribution_sessions + CASE WHEN day % 23 = 8 THEN 1 ELSE 0 END",
    "segments_oversampled": "segments_oversampled + CASE WHEN day % 29 = 9 THEN 1 ELSE 0 END",
}
REPORT = f"""WITH {FACTS}, {V.FRAMES}, {MARKS}, {SLOTS}, {NEAREST.partition(SLOTS + ', ')[2]}, {TOPICS},
    r0 AS (SELECT device, day, sum(CASE WHEN state NOT IN ('active', 'unattributed', 'idle', 'locked') THEN end_us - start_us ELSE 0 END) AS other_us, sum(CASE WHEN state IN ('active', 'unattributed') AND app IS NOT NULL THEN end_us - start_us ELSE 0 END) AS app_us FROM runs GROUP BY ALL),
    r1 AS (SELECT device, day, count(*) FILTER (NOT (day * {DAY} <= start_us AND start_us < end_us AND end_us <= (day + 1) * {DAY})) AS segments_outside, count(*) FILTER (start_us < before) AS segments_overlapping, count(*) FILTER (sampled_us < 0 OR sampled_us > end_us - start_us + 1000) AS segments_oversampled, sum(sampled_us) AS segment_us,
      coalesce(sum(sampled_us) FILTER (state = 'active'), 0) AS focus_us FROM (SELECT *, lag(end_us) OVER (PARTITION BY device, day ORDER BY start_us) AS before FROM segments) GROUP BY ALL),
    r2 AS (SELECT device, day, count(*) FILTER (NOT (day * {DAY} <= start_us AND start_us < end_us AND end_us <= (day + 1) * {DAY})) AS sessions_outside, count(*) AS sessions FROM parts GROUP BY ALL),
    r3 AS (SELECT device, day, sum(sessions) AS sessions_declared, max(app_union_us) AS longest_app_us, max(device_union_us) AS device_union_us FROM summary GROUP BY ALL),
    r4 AS (SELECT device, at_us // {DAY} AS day, count(*) AS frames, count(*) AS status_frames FROM frames GROUP BY ALL),
    r5 AS (SELECT device, day, sum(sampled_us) AS topic_us FROM al GROUP BY ALL),
    r6 AS (SELECT device, day, sum(us) AS suggested_us FROM (SELECT device, day, start_us, end_us, topic, floor(sum(us) * least(1.0::DOUBLE, sampled_us::DOUBLE / (end_us - start_us)::DOUBLE) + 0.5) AS us FROM near WHERE topic IS NOT NULL GROUP BY device, day, start_us, end_us, sampled_us, topic) GROUP BY ALL),
    r7 AS (SELECT device, day, sum(us) AS identified_us, sum(us) AS distribution_us, count(*) AS distribution_sessions, count(*) AS stretches, coalesce(sum(us) FILTER (us >= 1200000000), 0) AS sustained_us, max(us) AS longest_us FROM stretches GROUP BY ALL),
    w0 AS (SELECT t.device, t.day, t.active_us, t.unattributed_us, t.locked_us, t.idle_us, t.observed_us, t.unobserved_us, {DAY} AS span_us, {{cols}} FROM totals t LEFT JOIN r0 USING (device, day) LEFT JOIN r1 USING (device, day) LEFT JOIN r2 USING (device, day) LEFT JOIN r3 USING (device, day) LEFT JOIN r4 USING (device, day) LEFT JOIN r5 USING (device, day) LEFT JOIN r6 USING (device, day) LEFT JOIN r7 USING (device, day)),
    w AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in DRIFT.items())}) FROM w0)""".replace(
    "{cols}",
    ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("other_us", "app_us", "segments_outside", "segments_overlapping", "segments_oversampled", "segment_us", "focus_us", "sessions_outside", "sessions", "sessions_declared", "longest_app_us", "device_union_us", "frames", "status_frames", "topic_us", "suggested_us", "identified_us", "distribution_us", "distribution_sessions", "stretches", "sustained_us"))
    + ", coalesce(device_union_us, 0) AS union_us, longest_us",
)


def _report(spark, d):
    # Ten parts of the report read them.
    runs = written(_runs(spark, d))
    segs = written(A.segments(runs))
    frames = V.screens(spark, d).select("device", F.floor(F.col("at_us") / DAY).alias("day"), "status")
    return Q.accounting_report(runs, segs, by_day(V.sessions(spark, d)), A.session_summary(V.sessions(spark, d)), frames, _topics(spark, d, segs), C.screen_suggested(segs.where("state = 'unattributed'"), _marks(spark, d), A.KEYS), A.focus_blocks(segs), A.behavior_sessions(segs)).withColumns({k: F.expr(v) for k, v in DRIFT.items()})


@query(
    REPORT
    + """ SELECT code, count(*) AS days FROM (SELECT unnest(list_filter([
      CASE WHEN least(active_us, unattributed_us, locked_us, idle_us, observed_us, unobserved_us) < 0 THEN 'nonnegative_finite_time' END, CASE WHEN other_us <> 0 THEN 'known_states' END, CASE WHEN abs(active_us + unattributed_us + locked_us + idle_us + other_us - observed_us) > 20000 THEN 'state_sum' END,
      CASE WHEN abs(observed_us + unobserved_us - span_us) > 20000 THEN 'elapsed_reconciliation' END, CASE WHEN segments_outside > 0 THEN 'segment_bounds' END, CASE WHEN segments_overlapping > 0 THEN 'segment_overlap' END, CASE WHEN segments_oversampled > 0 THEN 'segment_sampled_time' END, CASE WHEN abs(segment_us - observed_us) > 20000 THEN 'segment_sum' END,
      CASE WHEN app_us > active_us + unattributed_us + 20000 THEN 'app_time_bound' END, CASE WHEN sessions_outside > 0 THEN 'session_bounds' END, CASE WHEN abs(union_us - device_union_us) > 20000 THEN 'union_reconciliation' END, CASE WHEN device_union_us < 0 OR device_union_us > span_us + 20000 THEN 'session_time_bound' END, CASE WHEN sessions_declared <> sessions THEN 'session_count' END,
      CASE WHEN longest_app_us < 0 OR longest_app_us > span_us + 20000 THEN 'session_app_time_bound' END, CASE WHEN status_frames <> frames THEN 'frame_status_reconciliation' END, CASE WHEN abs(topic_us - active_us) > 100000 THEN 'topic_time_reconciliation' END, CASE WHEN suggested_us > unattributed_us + 100000 THEN 'suggested_time_bound' END,
      CASE WHEN abs(focus_us - active_us) > 100000 THEN 'focus_time_reconciliation' END, CASE WHEN abs(identified_us - active_us) > 100000 THEN 'context_time_reconciliation' END, CASE WHEN abs(distribution_us - identified_us) > 100000 THEN 'context_distribution_reconciliation' END, CASE WHEN distribution_sessions <> stretches THEN 'context_session_count' END,
      CASE WHEN sustained_us < 0 OR sustained_us > identified_us + 100000 THEN 'sustained_context_bound' END, CASE WHEN longest_us < 0 OR longest_us > identified_us + 100000 THEN 'longest_context_bound' END], lambda x: x IS NOT NULL)) AS code FROM w) GROUP BY code"""
)
def check_accounting(spark, d):
    """The 23 accounting rules over all days, some of which were made to drift."""
    return Q.check_accounting(_report(spark, d))
