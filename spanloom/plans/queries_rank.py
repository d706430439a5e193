"""Queries of picks, orders, mixes, folds over frames, and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.time import MINUTE, SECOND
from spanloom.operators import activity as A
from spanloom.operators import fold as D
from spanloom.operators import rank as K
from spanloom.plans.book import Book
from spanloom.sources import adapters as V

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql


def _frames(spark, d):
    return V.frames(spark, d).drop("text")


def _segs(spark, d):
    return A.segments(A.observed_runs(V.samples(spark, d)))


@query(f"WITH {V.SEGMENTS}, t AS (SELECT device, state, app, CAST(sum(sampled_us) AS BIGINT) AS us, min(start_us) AS seen FROM segments WHERE app IS NOT NULL GROUP BY ALL) SELECT device, state, app, us, row_number() OVER (PARTITION BY device ORDER BY us DESC, seen) AS rank FROM t QUALIFY rank <= 3")
def top_k(spark, d):
    t = _segs(spark, d).where("app IS NOT NULL").groupBy("device", "state", "app").agg(F.sum("sampled_us").alias("us"), F.min("start_us").alias("seen"))
    return K.top_k(t, ["device"], "us", "seen", 3).drop("seen")


TOTALS = f"WITH {V.COMMITS}, t AS (SELECT author AS device, CASE WHEN repo % 6 <> 0 THEN 'r' || repo::VARCHAR END AS label, count(*) AS us FROM commits GROUP BY ALL)"


@query(
    TOTALS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY device, label IS NOT NULL ORDER BY us DESC, label) AS rank FROM t)
    SELECT device, CASE WHEN label IS NULL THEN 'Window unknown' WHEN rank <= 5 THEN label ELSE 'Other contexts' END AS label, CAST(sum(us) AS BIGINT) AS us FROM r GROUP BY ALL"""
)
def top_k_other(spark, d):
    c = V.commits(spark, d).withColumn("label", F.when(F.col("repo") % 6 != 0, F.concat(F.lit("r"), F.col("repo").cast("string"))))
    return K.top_k_other(c.groupBy(F.col("author").alias("device"), "label").agg(F.count(F.lit(1)).alias("us")), ["device"], "label", "us", 5)


@query(f"WITH {V.FRAMES} SELECT device, at_us // 60000000 AS bucket, id, at_us, app FROM frames QUALIFY row_number() OVER (PARTITION BY device, at_us // 60000000 ORDER BY at_us DESC, id DESC) = 1")
def latest_per_bucket(spark, d):
    return K.latest_per_bucket(_frames(spark, d).select("device", "id", "at_us", "app"), ["device"], "at_us", 60 * SECOND, "id")


@query(f"WITH {V.FRAMES} SELECT device, at_us // 120000000 AS bucket, id, n_chars FROM frames QUALIFY row_number() OVER (PARTITION BY device, at_us // 120000000 ORDER BY (display = 'en') DESC, n_chars DESC, id) = 1")
def best_per_bucket(spark, d):
    f = _frames(spark, d).withColumn("main", F.col("display") == "en")
    return K.best_per_bucket(f, ["device"], "at_us", 2 * MINUTE, ["main", "n_chars"], "id").select("device", "bucket", "id", "n_chars")


POS = f"WITH {V.FRAMES}, p AS (SELECT device, app, id, row_number() OVER (PARTITION BY device ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY device) AS n FROM frames)"


@query(POS + ", k AS (SELECT DISTINCT device, CAST(round_even(i * (n - 1) / 6.0, 0) AS BIGINT) AS pos FROM (SELECT DISTINCT device, n FROM p), (SELECT unnest(range(7)) AS i)) SELECT device, id, pos FROM p WHERE n <= 7 OR EXISTS (SELECT 1 FROM k WHERE k.device = p.device AND k.pos = p.pos)")
def even_spread(spark, d):
    return K.even_spread(_frames(spark, d).select("device", "id"), ["device"], "id", 7)


BISECT = """ lv AS (SELECT g, 0::BIGINT AS lo, n - 1 AS hi, 0 AS level FROM sizes
      UNION ALL SELECT g, unnest([lo, (lo + hi) // 2 + 1]) AS lo, unnest([(lo + hi) // 2 - 1, hi]) AS hi, level + 1 FROM lv WHERE hi > lo),
    lvl AS (SELECT g, (lo + hi) // 2 AS pos, level FROM lv WHERE lo <= hi)"""


@query(POS.replace("WITH ", "WITH RECURSIVE ") + ", sizes AS (SELECT DISTINCT device AS g, n FROM p)," + BISECT + " SELECT p.device, id, p.pos, row_number() OVER (PARTITION BY p.device ORDER BY level, p.pos) AS ord FROM p JOIN lvl ON lvl.g = p.device AND lvl.pos = p.pos")
def bisect_order(spark, d):
    return K.bisect_order(_frames(spark, d).select("device", "id"), ["device"], "id")


@query(
    POS.replace("WITH ", "WITH RECURSIVE ")
    + f""", x AS (SELECT device, app, id, row_number() OVER (PARTITION BY device, app ORDER BY id) AS r, count(*) OVER (PARTITION BY device, app) AS m FROM p),
    f AS (SELECT device, id, row_number() OVER (PARTITION BY device ORDER BY id) - 1 AS pos FROM x WHERE r = m // 2 + 1), sizes AS (SELECT device AS g, count(*) AS n FROM f GROUP BY device),{BISECT},
    a AS (SELECT f.device, f.id, 0 AS stage, row_number() OVER (PARTITION BY f.device ORDER BY level, f.pos) AS o FROM f JOIN lvl ON lvl.g = f.device AND lvl.pos = f.pos
      UNION ALL SELECT device, id, 1, row_number() OVER (PARTITION BY device ORDER BY id) FROM x WHERE r <> m // 2 + 1)
    SELECT device, id, row_number() OVER (PARTITION BY device ORDER BY stage, o) AS ord FROM a"""
)
def context_priority(spark, d):
    return K.context_priority(_frames(spark, d).select("device", "app", "id"), ["device"], ["app"], "id").select("device", "id", "ord")


@query(POS + ", t AS (SELECT device, app, id, row_number() OVER (PARTITION BY device, app ORDER BY id) AS turn FROM p) SELECT device, app, id, turn, row_number() OVER (PARTITION BY device ORDER BY turn, app) AS ord FROM t QUALIFY ord <= 40")
def round_robin(spark, d):
    return K.round_robin(_frames(spark, d).select("device", "app", "id"), ["device"], "app", "id", 40)


@query(POS + ", k AS (SELECT DISTINCT device, i * n // 60 AS pos FROM (SELECT DISTINCT device, n FROM p), (SELECT unnest(range(60)) AS i)) SELECT device, id, pos FROM p WHERE n <= 60 OR EXISTS (SELECT 1 FROM k WHERE k.device = p.device AND k.pos = p.pos)")
def stride_sample(spark, d):
    return K.stride_sample(_frames(spark, d).select("device", "id"), ["device"], "id", 60)


@query(
    POS
    + """, c AS (SELECT device, id, 'current' AS lane, row_number() OVER (PARTITION BY device ORDER BY id) AS r FROM p WHERE id % 8 >= 4), h AS (SELECT device, id, 'history' AS lane, row_number() OVER (PARTITION BY device ORDER BY id) AS r FROM p WHERE id % 8 < 4),
    b AS (SELECT *, r + (r - 1) // 9 AS slot FROM c UNION ALL SELECT *, r * 10 FROM h) SELECT device, id, lane, row_number() OVER (PARTITION BY device ORDER BY slot, lane, r) AS ord FROM b QUALIFY ord <= 100"""
)
def ratio_mix(spark, d):
    f = _frames(spark, d).select("device", "id")
    return K.ratio_mix(f.where("id % 8 >= 4"), f.where("id % 8 < 4"), ["device"], "id", 9, 100)


@query(POS + ", b AS (SELECT device, id, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS lane FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY device, lane ORDER BY id) AS r FROM b) SELECT device, id, lane, row_number() OVER (PARTITION BY device ORDER BY r, lane) AS ord FROM r")
def alternate(spark, d):
    f = _frames(spark, d).select("device", "id")
    return K.alternate(f.where("id % 3 = 0"), f.where("id % 3 <> 0"), ["device"], "id")


@query(f"WITH {V.FRAMES}, s AS (SELECT device, app, display, id, row_number() OVER (PARTITION BY device, app, display ORDER BY id) AS seen FROM frames), t AS (SELECT *, row_number() OVER (PARTITION BY device, app ORDER BY seen, id) AS turn FROM s) SELECT device, app, id, turn, row_number() OVER (PARTITION BY device ORDER BY turn, app) AS ord FROM t QUALIFY ord <= 50")
def quality_diverse(spark, d):
    return K.quality_diverse(_frames(spark, d).select("device", "app", "display", "id"), ["device"], ["app"], "display", "id", 50).drop("display")


@query(
    f"WITH RECURSIVE {V.SEGMENTS}, s AS (SELECT device, start_us, (start_us // 3600000000) % 24 AS hour, sampled_us FROM segments WHERE state = 'active'), t AS (SELECT *, row_number() OVER (PARTITION BY device, hour ORDER BY sampled_us DESC, start_us) AS turn FROM s),"
    f" hp AS (SELECT device, hour, row_number() OVER (PARTITION BY device ORDER BY hour) - 1 AS pos FROM (SELECT DISTINCT device, hour FROM s)), sizes AS (SELECT device AS g, count(*) AS n FROM hp GROUP BY device),{BISECT},"
    " ho AS (SELECT hp.device, hp.hour, row_number() OVER (PARTITION BY hp.device ORDER BY level, hp.pos) AS ho FROM hp JOIN lvl ON lvl.g = hp.device AND lvl.pos = hp.pos) SELECT t.device, t.hour, t.start_us, t.sampled_us, turn, row_number() OVER (PARTITION BY t.device ORDER BY turn, ho) AS ord FROM t JOIN ho USING (device, hour)"
)
def hour_coverage(spark, d):
    s = _segs(spark, d).where("state = 'active'").select("device", "start_us", (F.floor(F.col("start_us") / 3_600_000_000) % 24).alias("hour"), "sampled_us")
    return K.hour_coverage(s, ["device"], "hour", "sampled_us", "start_us")


@query(POS + " SELECT device, id, row_number() OVER (PARTITION BY device ORDER BY md5('7:' || id::VARCHAR), id) AS ord FROM p")
def seeded_shuffle(spark, d):
    return K.seeded_order(_frames(spark, d).select("device", "id"), ["device"], "id", 7)


@query(POS + " SELECT device, id, pos + 1 AS pos, n AS total FROM p WHERE pos >= 40 AND pos < 60")
def page(spark, d):
    return K.page(_frames(spark, d).select("device", "id"), ["device"], "id", 40)


LANES = f"""WITH {V.ANNOTATIONS}, first AS (SELECT * FROM annotations WHERE n = 1), l AS (SELECT path, CASE WHEN status = 'incomplete' THEN 'retry' WHEN status = 'filtered' THEN 'hard' WHEN elapsed_s > 25 THEN 'quality' ELSE 'direct' END AS lane, path % 4 AS device FROM first)"""


@query(LANES + ", r AS (SELECT *, row_number() OVER (PARTITION BY device, lane ORDER BY path) AS r FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY r, lane) AS ord FROM r) SELECT device, lane, count(*) AS selected FROM o WHERE ord <= 200 GROUP BY ALL")
def selection_plan(spark, d):
    """Lanes in turn under one limit, and how many each got."""
    a = V.annotations(spark, d).where("n = 1")
    lane = F.when(F.col("status") == "incomplete", "retry").when(F.col("status") == "filtered", "hard").when(F.col("elapsed_s") > 25, "quality").otherwise("direct")
    picked = K.round_robin(a.select("path", lane.alias("lane"), (F.col("path") % 4).alias("device")), ["device"], "lane", "path", 200)
    return picked.groupBy("device", "lane").agg(F.count(F.lit(1)).alias("selected"))


SPLIT = f"WITH {V.FRAMES}, dd AS (SELECT id, app, at_us // 86400000000 AS day FROM frames), md AS (SELECT max(day) AS d1, (SELECT max(day) FROM dd WHERE day < (SELECT max(day) FROM dd)) AS d2 FROM dd), sp AS (SELECT dd.*, CASE WHEN day = d1 THEN 'test' WHEN day = d2 THEN 'validation' ELSE 'train' END AS split FROM dd, md)"


@query(SPLIT + " SELECT id, day, split FROM sp")
def temporal_split(spark, d):
    return K.temporal_split(_frames(spark, d).select("id", F.floor(F.col("at_us") / 86_400_000_000).alias("day")), "day")


@query(SPLIT + " SELECT app, count(DISTINCT split) AS splits FROM sp GROUP BY app HAVING count(DISTINCT split) > 1")
def split_leakage(spark, d):
    told = K.temporal_split(_frames(spark, d).select("id", "app", F.floor(F.col("at_us") / 86_400_000_000).alias("day")), "day")
    return K.split_leaks(told, "app")


FOLD_ROWS = """v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS device, vec_id * 10000000 AS at_us, 'app' || ((vec_id // 100) % 2)::VARCHAR AS app, vec_id % 9 <> 0 AS eligible, embedding::DOUBLE[] AS vector FROM embeddings),
    o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY at_us, id) AS r FROM v)"""
#: Far enough that the synthetic vectors, which differ more than neighbouring screens do, make clusters.
NEAR, SPAN = 1.2, 400


@query(
    f"""WITH RECURSIVE {FOLD_ROWS}, f AS (SELECT device, r, id, at_us, vector, id AS kept_id, at_us AS kept_at, vector AS kept_v, true AS keep FROM o WHERE r = 1
    UNION ALL SELECT device, r, id, at_us, vector, CASE WHEN drop THEN kept_id ELSE id END, CASE WHEN drop THEN kept_at ELSE at_us END, CASE WHEN drop THEN kept_v ELSE vector END, NOT drop
    FROM (SELECT o.*, f.kept_id, f.kept_at, f.kept_v, o.at_us - f.kept_at <= {SPAN}000000 AND list_distance(o.vector, f.kept_v) <= {NEAR} AS drop FROM f JOIN o ON o.device = f.device AND o.r = f.r + 1))
    SELECT device, id, at_us FROM f WHERE keep"""
)
def feature_dedupe(spark, d):
    return D.feature_dedupe(V.vectors(spark, d), ["device"], SPAN * SECOND, NEAR)


CLUSTERS = f"""WITH RECURSIVE {FOLD_ROWS}, f AS (SELECT device, r, id, at_us, app, eligible, CASE WHEN eligible THEN id END AS first_id, CASE WHEN eligible THEN at_us END AS first_at, CASE WHEN eligible THEN vector END AS first_v, CASE WHEN eligible THEN app END AS last_app FROM o WHERE r = 1
    UNION ALL SELECT device, r, id, at_us, app, eligible, CASE WHEN NOT eligible THEN NULL WHEN joins THEN first_id ELSE id END, CASE WHEN NOT eligible THEN NULL WHEN joins THEN first_at ELSE at_us END, CASE WHEN NOT eligible THEN NULL WHEN joins THEN first_v ELSE vector END, CASE WHEN eligible THEN app ELSE last_app END
    FROM (SELECT o.device, o.r, o.id, o.at_us, o.app, o.eligible, o.vector, f.first_id, f.first_at, f.first_v, f.last_app,
        f.first_id IS NOT NULL AND o.app = f.last_app AND o.at_us - f.first_at <= {SPAN}000000 AND list_distance(o.vector, f.first_v) <= {NEAR} AS joins FROM f JOIN o ON o.device = f.device AND o.r = f.r + 1)),
    clusters AS (SELECT device, id, at_us, first_id FROM f WHERE eligible)"""


def _clusters(spark, d):
    return D.similarity_clusters(V.vectors(spark, d), ["device"], SPAN * SECOND, NEAR)


@query(CLUSTERS + " SELECT * FROM clusters")
def similarity_clusters(spark, d):
    return _clusters(spark, d)


@query(
    CLUSTERS
    + """, lb AS (SELECT c.*, CASE WHEN c.id % 3 = 0 THEN 'L' || ((c.id // 30) % 2)::VARCHAR END AS label FROM clusters c),
    g AS (SELECT first_id, count(DISTINCT label) AS n, min(label) AS label, min(id) FILTER (label IS NOT NULL) AS anchor FROM lb GROUP BY first_id)
    SELECT c.device, c.id, c.at_us, c.first_id, g.label, g.anchor FROM clusters c JOIN g USING (first_id) WHERE n = 1"""
)
def label_propagation(spark, d):
    c = _clusters(spark, d)
    labels = V.vectors(spark, d).where("id % 3 = 0").select("id", F.concat(F.lit("L"), (F.floor(F.col("id") / 30) % 2).cast("string")).alias("label"))
    return D.label_propagation(c, labels)


CADENCE = """WITH RECURSIVE x AS (SELECT doc_id AS id, doc_id % 4 AS device, 1704067200000000 + (doc_id % 100) * 10000000 + (doc_id // 100) * 259200000000 AS at_us, lang AS context, n_chars % 3 AS digest, n_chars / 100.0::DOUBLE AS level FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY at_us, id) AS r FROM x), f AS (SELECT device, r, id, at_us, at_us AS k_at, context AS k_c, digest AS k_d, level AS k_l, true AS keep FROM o WHERE r = 1
    UNION ALL SELECT device, r, id, at_us, CASE WHEN drop THEN k_at ELSE at_us END, CASE WHEN drop THEN k_c ELSE context END, CASE WHEN drop THEN k_d ELSE digest END, CASE WHEN drop THEN k_l ELSE level END, NOT drop
    FROM (SELECT o.*, f.k_at, f.k_c, f.k_d, f.k_l, o.context = f.k_c AND (o.at_us - f.k_at < 20000000 OR (o.at_us - f.k_at < 120000000 AND (o.digest = f.k_d OR abs(o.level - f.k_l) < 10.0))) AS drop FROM f JOIN o ON o.device = f.device AND o.r = f.r + 1))
    SELECT device, id, at_us FROM f WHERE keep"""


@query(CADENCE)
def cadence_keep(spark, d):
    f = _frames(spark, d).select("device", "id", "at_us", F.col("display").alias("context"), (F.col("n_chars") % 3).alias("digest"), (F.col("n_chars") / 100.0).alias("level"))
    return D.cadence_keep(f, ["device"], change=10.0)


@query(
    f"""WITH {V.FRAMES}, m AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER w <= 120000000 AND lag(display) OVER w IS NOT DISTINCT FROM display THEN 0 ELSE 1 END AS new FROM frames WINDOW w AS (PARTITION BY device ORDER BY at_us, id)),
    e AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY at_us, id) AS e FROM m) SELECT device, arg_min(id, (at_us, id)) AS episode, min(at_us) AS start_us, max(at_us) AS end_us, count(*) AS frames FROM e GROUP BY device, e"""
)
def frame_episodes(spark, d):
    return D.frame_episodes(_frames(spark, d), ["device"], ["display"])


@query("WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.id AS a, b.id AS b, CAST(floor(list_distance(a.e, b.e) * 1e6 + 0.5) AS BIGINT) AS distance_ppm FROM v a JOIN v b ON b.id = a.id + 1")
def l2_distance(spark, d):
    v = V.vectors(spark, d)
    a, b = v.select(F.col("id").alias("a"), F.col("vector").alias("x")), v.select(F.col("id").alias("b"), (F.col("id") - 1).alias("a"), F.col("vector").alias("y"))
    return a.join(b, "a").select("a", "b", F.floor(D.l2(F.col("x"), F.col("y")) * 1e6 + 0.5).alias("distance_ppm"))


@query("SELECT d.doc_id AS id, d.lang, l.toxic IS NOT NULL AS has_features, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_join_features(spark, d):
    f = V.frames(spark, d).select("id", F.col("display").alias("lang"))
    t = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("quality"), F.col("toxic"))
    return f.join(t, "id", "left").select("id", "lang", F.col("toxic").isNotNull().alias("has_features"), "quality")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark, d):
    return V.frames(spark, d).select("id").join(V.tags(spark, d).select("id"), "id", "left_anti")
