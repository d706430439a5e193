"""Selections whose next step depends on the last row kept or on a cluster's first: each row's successor, then its chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.time import DAY, SECOND
from spanloom.operators.chain import followed
from spanloom.operators.interval import with_same
from spanloom.operators.rank import numbered
from spanloom.sources.scratch import written


def l2(a, b):
    """Euclidean distance of two array columns, in doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def _ahead(frames: DataFrame, keys: list[str], span_us: int, cols: list[str]) -> DataFrame:
    """frames numbered by (at_us, id) as n, with `ahead`: this row and those up to span_us after it, in order, as structs.

    Rows without a time are left out. Windows are a key's day, or its span if that is longer, and what the last rows look
    at beyond it; a row's work is the rows in its span.
    """
    told = frames.where("at_us IS NOT NULL").select(*keys, "id", "at_us", *cols)
    told = numbered(told, keys, ["at_us", "id", F.xxhash64(*told.columns)], [F.floor(F.col("at_us") / DAY)], "n")
    return _looked(told, keys, span_us, cols)


def _looked(told: DataFrame, keys: list[str], span_us: int, cols: list[str]) -> DataFrame:
    size = max(DAY, span_us)
    own, early = F.floor(F.col("at_us") / size), F.pmod(F.col("at_us"), F.lit(size)) <= span_us
    both = told.withColumn("__own", own).withColumn("__in", F.explode(F.when(early, F.array("__own", F.col("__own") - 1)).otherwise(F.array("__own"))))
    w = Window.partitionBy(*keys, "__in").orderBy("at_us").rangeBetween(0, span_us)
    seen = both.withColumn("ahead", F.collect_list(F.struct("n", "at_us", *cols)).over(w)).where("__own = __in").drop("__own", "__in")
    return seen.withColumn("ahead", F.sort_array(F.filter("ahead", lambda x: x.n >= F.col("n"))))


def _next(drops) -> Column:
    """The number of the first row after this one that drops(x, before) doesn't drop, `before` being x's predecessor."""
    first = F.get(F.filter("ahead", lambda x, i: (i > 0) & ~drops(x, F.get("ahead", i - 1))), F.lit(0)).n
    return F.coalesce(first, F.col("n") + F.size("ahead"))


def _near(x: Column, distance: float) -> Column:
    return F.coalesce(l2(F.col("vector"), x.vector) <= distance, F.lit(False))


def feature_dedupe(frames: DataFrame, keys: list[str], span_us: int = 120 * SECOND, distance: float = 0.10) -> DataFrame:
    """Frames (id, at_us, vector) without those within span_us and distance of the last one kept of the same keys.

    A kept frame without a vector becomes the reference all the same, and then nothing matches it; vectors of unequal
    lengths or with nulls match none.
    """
    told = _ahead(frames, keys, span_us, ["vector"]).withColumn("next", _next(lambda x, _: _near(x, distance)))
    return followed(told, keys, ["id", "at_us"]).select(*keys, "id", "at_us")


def similarity_clusters(frames: DataFrame, keys: list[str], span_us: int = 120 * SECOND, distance: float = 0.10) -> DataFrame:
    """(keys, id, at_us, first_id): a frame joins if its app is the frame's before and it is near the cluster's first.

    A frame that is not eligible, or has no vector, ends a cluster and is in none.
    """
    cols = ["app", "vector", "eligible"]
    told = frames.where("at_us IS NOT NULL").withColumn("eligible", F.coalesce("eligible", F.lit(False)) & F.col("vector").isNotNull()).select(*keys, "id", "at_us", *cols)
    told = written(numbered(told, keys, ["at_us", "id", F.xxhash64(*told.columns)], [F.floor(F.col("at_us") / DAY)], "n"))
    joins = lambda x, before: F.col("eligible") & x.eligible & before.eligible & x.app.eqNullSafe(before.app) & _near(x, distance)
    first = followed(_looked(told, keys, span_us, cols).withColumn("next", _next(joins)), keys, ["id", "eligible"])
    of = first.where("eligible").select(*keys, F.explode(F.sequence("n", F.col("next") - 1)).alias("n"), F.col("id").alias("first_id"))
    return with_same(told, of, [*keys, "n"]).select(*keys, "id", "at_us", "first_id")


def label_propagation(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of clusters with exactly one distinct label get it, with the earliest labelled member as anchor."""
    told = clusters.join(labels, "id", "left")
    per = told.groupBy("first_id").agg(F.count_distinct("label").alias("labels"), F.min("label").alias("label"), F.min_by("id", F.when(F.col("label").isNotNull(), F.struct("at_us", "id"))).alias("anchor"))
    return clusters.join(per.where("labels = 1").drop("labels"), "first_id")


def cadence_keep(frames: DataFrame, keys: list[str], least_us: int = 20 * SECOND, most_us: int = 120 * SECOND, change: float = 1.0) -> DataFrame:
    """Frames (id, at_us, context, digest, level) to keep: the first, a change of context, then by age and change.

    Under least_us after the last kept one: drop. From most_us on: keep. The same digest: drop. Else keep if the level
    differs by `change` or more.
    """

    age, level = lambda x: x.at_us - F.col("at_us"), lambda x: F.coalesce(F.abs(x.level - F.col("level")) < change, F.lit(False))
    same = lambda x: F.coalesce(x.digest == F.col("digest"), F.lit(False)) | level(x)
    drops = lambda x, _: x.context.eqNullSafe(F.col("context")) & ((age(x) < least_us) | (age(x) < most_us) & same(x))
    told = _ahead(frames, keys, max(least_us, most_us), ["context", "digest", "level"]).withColumn("next", _next(drops))
    return followed(told, keys, ["id", "at_us"]).select(*keys, "id", "at_us")


def frame_episodes(frames: DataFrame, keys: list[str], context: list[str], gap_us: int = 120 * SECOND) -> DataFrame:
    """Frames in a row of one context with gaps of gap_us at most; the first frame names the episode. Midnight ends none.

    Episodes are found by day; then those that reach a day's first or last frame are joined over midnights.
    """
    day = [*keys, "__day"]
    w = Window.partitionBy(*day).orderBy("at_us", "id")
    told = frames.withColumn("__day", F.floor(F.col("at_us") / DAY)).withColumn("__c", F.struct(*context))
    same = F.coalesce(F.col("at_us") - F.lag("at_us").over(w) <= gap_us, F.lit(False)) & F.lag("__c").over(w).eqNullSafe(F.col("__c"))
    told = told.withColumn("__e", F.sum((~same).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = told.groupBy(*day, "__e").agg(F.min_by("id", F.struct("at_us", "id")).alias("episode"), F.min("at_us").alias("start_us"), F.max("at_us").alias("end_us"), F.count(F.lit(1)).alias("frames"), F.first("__c").alias("__c"))
    parts = parts.withColumn("__edge", (F.col("__e") == 1) | (F.col("__e") == F.max("__e").over(Window.partitionBy(*day))))
    v = Window.partitionBy(*keys).orderBy("__day", "__e")
    joins = F.coalesce((F.lag("__day").over(v) < F.col("__day")) & (F.col("start_us") - F.lag("end_us").over(v) <= gap_us), F.lit(False)) & F.lag("__c").over(v).eqNullSafe(F.col("__c"))
    edge = parts.where("__edge").withColumn("__n", F.sum((~joins).cast("long")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edge.groupBy(*keys, "__n").agg(F.min_by("episode", F.struct("__day", "__e")).alias("episode"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("frames").alias("frames"))
    cols = [*keys, "episode", "start_us", "end_us", "frames"]
    return whole.select(*cols).unionByName(parts.where("NOT __edge").select(*cols))


def with_episode(frames: DataFrame, keys: list[str], context: list[str], gap_us: int = 120 * SECOND) -> DataFrame:
    """frames with `episode`, as frame_episodes() names it: the first frame of their row of one context, also over midnights."""
    day = [*keys, "__day"]
    w = Window.partitionBy(*day).orderBy("at_us", "id")
    told = frames.withColumn("__day", F.floor(F.col("at_us") / DAY)).withColumn("__c", F.struct(*context))
    same = F.coalesce(F.col("at_us") - F.lag("at_us").over(w) <= gap_us, F.lit(False)) & F.lag("__c").over(w).eqNullSafe(F.col("__c"))
    told = told.withColumn("__e", F.sum((~same).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = told.groupBy(*day, "__e").agg(F.min_by("id", F.struct("at_us", "id")).alias("episode"), F.min("at_us").alias("start_us"), F.max("at_us").alias("end_us"), F.first("__c").alias("__c"))
    edge = parts.withColumn("__edge", (F.col("__e") == 1) | (F.col("__e") == F.max("__e").over(Window.partitionBy(*day)))).where("__edge")
    v = Window.partitionBy(*keys).orderBy("__day", "__e")
    joins = F.coalesce((F.lag("__day").over(v) < F.col("__day")) & (F.col("start_us") - F.lag("end_us").over(v) <= gap_us), F.lit(False)) & F.lag("__c").over(v).eqNullSafe(F.col("__c"))
    edge = edge.withColumn("__n", F.sum((~joins).cast("long")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    first = edge.withColumn("named", F.first("episode").over(Window.partitionBy(*keys, "__n").orderBy("__day", "__e"))).select(*day, "__e", "named")
    names = parts.select(*day, "__e", "episode").join(first, [*day, "__e"], "left").select(*day, "__e", F.coalesce("named", "episode").alias("episode"))
    return with_same(told, names, [*day, "__e"]).drop("__day", "__e", "__c")
