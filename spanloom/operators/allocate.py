"""Evidence to time: user labels over model hypotheses over unknown, each foreground second once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.interval import merge, overlap_join
from spanloom.sources.scratch import written

FRONT = ("active", "unattributed")


def _one_shape(hypotheses: DataFrame) -> tuple[int, int] | None:
    """How far all scopes reach before and after their anchors, if that is the same for all and none lies outside its scope."""
    found = hypotheses.select((F.col("anchor_us") - F.col("start_us")).alias("before"), (F.col("end_us") - F.col("anchor_us")).alias("after")).distinct().limit(2).collect()
    if len(found) > 1 or found and (None in found[0] or min(found[0]) < 0):
        return None
    return tuple(found[0]) if found else (0, 0)


def _midpoints(span: DataFrame, hypotheses: DataFrame, shape: tuple[int, int] | None, keys: list[str]) -> DataFrame:
    """Midpoints t of neighbouring anchors (keys, t, low, high): they cut a run that meets [low, high).

    Scopes of one shape that meet a run are those of a row of anchors, so neighbours there are neighbours everywhere; of
    other scopes each run meets its own.
    """
    mid = F.floor((F.col("before") + F.col("anchor_us")) / 2)
    if shape is not None:
        w = Window.partitionBy(*keys).orderBy("anchor_us")
        told = hypotheses.select(*keys, "anchor_us").distinct().withColumn("before", F.lag("anchor_us").over(w)).where("before IS NOT NULL")
        return told.select(*keys, mid.alias("t"), (F.col("anchor_us") - shape[0]).alias("low"), (F.col("before") + shape[1]).alias("high"))
    anchors = overlap_join(span, hypotheses.select(*keys, "start_us", "end_us", "anchor_us"), keys).select(*keys, "id", "a_start", "a_end", "anchor_us").distinct()
    told = anchors.withColumn("before", F.lag("anchor_us").over(Window.partitionBy(*keys, "id").orderBy("anchor_us"))).where("before IS NOT NULL")
    return told.withColumn("t", mid).where("t > a_start AND t < a_end").select(*keys, "t", F.col("t").alias("low"), (F.col("t") + 1).alias("high"))


def scope_pieces(runs: DataFrame, corrections: DataFrame, hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """Runs cut at edges of corrections and hypothesis scopes inside them, and at midpoints of anchors of one run.

    runs: keys, id, start_us, end_us, state, disjoint by keys. corrections: start_us, end_us. hypotheses: start_us, end_us,
    anchor_us. Midpoints are taken between neighbouring anchors: between others, a nearer anchor decides anyway.

    A cut lies in one run at most, the last one that begins before it: one window over runs and cuts in order of time finds
    it. So runs don't meet all scopes over them, whose pairs grow with the square of how dense the rows are.
    """
    return _pieces(runs, corrections, hypotheses, _one_shape(hypotheses), keys)


def _pieces(runs: DataFrame, corrections: DataFrame, hypotheses: DataFrame, shape: tuple[int, int] | None, keys: list[str]) -> DataFrame:
    runs = runs.select(*keys, "id", "start_us", "end_us", "state").where("end_us > start_us")
    if shape is None:
        runs = written(runs)
    edges = lambda df: df.select(*keys, F.explode(F.array("start_us", "end_us")).alias("t"), F.col("start_us").alias("low"), F.col("end_us").alias("high"))
    cuts = edges(corrections).unionByName(edges(hypotheses)).unionByName(_midpoints(runs.drop("state"), hypotheses, shape, keys))
    run = F.struct("id", "start_us", "end_us", "state")
    told = runs.select(*keys, F.col("start_us").alias("t"), F.lit(False).alias("cut"), run.alias("r")).unionByName(cuts.withColumn("cut", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t", "cut")
    told = told.withColumn("r", F.last("r", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.col("t") > F.col("r.start_us")) & (F.col("t") < F.col("r.end_us")) & (F.col("low") < F.col("r.end_us")) & (F.col("high") > F.col("r.start_us"))
    points = told.where(~F.col("cut") | inside).withColumn("next", F.lead("t").over(w))
    # Cuts at one moment are one: what lies between them is empty.
    return points.select(*keys, "r.id", F.col("t").alias("start_us"), F.least("next", "r.end_us").alias("end_us"), "r.state").where("end_us > start_us")


def _label_steps(corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint stretches (keys, start_us, end_us) with how many labels hold there, c_n, and the first, c_label.

    Corrections of one label are merged first, so a stretch meets each label once, however many lie over it.
    """
    own = merge(corrections.where("end_us > start_us"), [*keys, "label"])
    times = own.select(*keys, F.explode(F.array("start_us", "end_us")).alias("t")).distinct()
    spans = times.select(*keys, F.col("t").alias("start_us"), F.lead("t").over(Window.partitionBy(*keys).orderBy("t")).alias("end_us")).where("end_us IS NOT NULL")
    met = overlap_join(spans, own, keys).groupBy(*keys, F.col("a_start").alias("start_us"), F.col("a_end").alias("end_us"))
    return met.agg(F.count_distinct("label").alias("c_n"), F.min("label").alias("c_label"))


def _anchor_steps(hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """From each anchor on (keys, t): it as `last`, the one after as `next`, each with its labels; and a row before the first."""
    per = hypotheses.groupBy(*keys, "anchor_us").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label"))
    one, w = F.struct("anchor_us", "n", "label"), Window.partitionBy(*keys).orderBy("anchor_us")
    told = per.select(*keys, one.alias("last"), F.lead(one).over(w).alias("next"), F.row_number().over(w).alias("r"))
    own = F.struct(F.col("last.anchor_us").alias("t"), "last", "next")
    first = F.struct(F.lit(-(1 << 63)).cast("long").alias("t"), F.when(F.lit(False), F.col("last")).alias("last"), F.col("last").alias("next"))
    return told.select(*keys, F.explode(F.when(F.col("r") == 1, F.array(first, own)).otherwise(F.array(own))).alias("x")).select(*keys, "x.*")


def _nearer(shape: tuple[int, int]) -> Column:
    """h_n and h_label of the anchor nearest to mid, `last` or `next`, if its scope meets the piece; of both if equally near."""
    at = lambda side: F.col(f"h.{side}.anchor_us")
    meets = lambda side: F.coalesce((at(side) - shape[0] < F.col("end_us")) & (F.col("start_us") < at(side) + shape[1]), F.lit(False))
    given = lambda side: F.struct(F.col(f"h.{side}.n").alias("h_n"), F.col(f"h.{side}.label").alias("h_label"))
    a, b, d = F.col("h.last"), F.col("h.next"), (F.col("mid") - at("last")) - (at("next") - F.col("mid"))
    n = F.when(a.n == 0, b.n).when((b.n == 0) | (a.n == 1) & (b.n == 1) & (a.label == b.label), a.n).otherwise(F.greatest(a.n, b.n, F.lit(2)))
    both = F.struct(n.alias("h_n"), F.least(a.label, b.label).alias("h_label"))
    return F.when(meets("last") & meets("next"), F.when(d < 0, given("last")).when(d > 0, given("next")).otherwise(both)).when(meets("last"), given("last")).when(meets("next"), given("next"))


def _met_hypotheses(pieces: DataFrame, hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """h_n and h_label of the nearest hypotheses by piece, for scopes of several shapes: each piece meets all over it."""
    own = [*keys, "id", "a_start", "a_end"]
    h = overlap_join(pieces.where(F.col("state").isin(*FRONT)).select(*keys, "id", "start_us", "end_us", "mid"), hypotheses.select(*keys, "start_us", "end_us", "anchor_us", F.col("label").alias("h_l")), keys)
    h = h.withColumn("d", F.abs(F.col("anchor_us") - F.col("mid"))).groupBy(*own, "d").agg(F.count_distinct("h_l").alias("h_n"), F.min("h_l").alias("h_label"))
    h = h.groupBy(*own).agg(F.min_by(F.struct("h_n", "h_label"), "d").alias("near"))
    return h.withColumnsRenamed({"a_start": "start_us", "a_end": "end_us"})


def allocate(runs: DataFrame, corrections: DataFrame, hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of runs with label and tier.

    Corrections (start_us, end_us, label) apply to unattributed runs: one distinct label confirms, several conflict and
    give none, never falling back. Else the nearest hypotheses (scope, anchor_us, label) by the piece's midpoint: one
    distinct label is the model's, several at one distance conflict. Else unclassified. Idle and locked are not
    foreground.

    A piece is cut at all edges, so what holds at its midpoint holds throughout. If all scopes have one shape, one window over
    pieces, stretches of labels and anchors in order of time finds both; else each piece meets all scopes over it.
    """
    shape = _one_shape(hypotheses)
    pieces = _pieces(runs, corrections, hypotheses, shape, keys).withColumn("mid", F.floor((F.col("start_us") + F.col("end_us")) / 2))
    if shape is None:
        pieces = written(pieces)
    steps = [_label_steps(corrections, keys).select(*keys, F.col("start_us").alias("t"), F.struct("end_us", "c_n", "c_label").alias("c"))]
    if shape is not None:
        steps.append(_anchor_steps(hypotheses, keys).select(*keys, "t", F.struct("last", "next").alias("h")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [pieces.withColumns({"t": F.col("mid"), "piece": F.lit(True)}), *[s.withColumn("piece", F.lit(False)) for s in steps]])
    w = Window.partitionBy(*keys).orderBy("t", "piece").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumns({x: F.last(x, True).over(w) for x in ("c", "h")[: len(steps)]}).where("piece")
    near = met.join(_met_hypotheses(pieces, hypotheses, keys), [*keys, "id", "start_us", "end_us"], "left") if shape is None else met.withColumn("near", _nearer(shape))
    c_n, h_n = F.when((F.col("state") == "unattributed") & (F.col("c.end_us") > F.col("mid")), F.col("c.c_n")), F.col("near.h_n")
    tier = (
        F.when(~F.col("state").isin(*FRONT), "nonforeground")
        .when(c_n == 1, "user_confirmed_label")
        .when(c_n > 1, "user_correction_conflict")
        .when(h_n == 1, "model_inference")
        .when(h_n > 1, "model_conflict")
        .otherwise("unclassified")
    )
    label = F.when(F.col("tier") == "user_confirmed_label", F.col("c.c_label")).when(F.col("tier") == "model_inference", F.col("near.h_label"))
    return near.withColumn("tier", tier).withColumn("label", label).select(*keys, "id", "start_us", "end_us", "state", "tier", "label")


def reconciled(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Five totals that add up: observed = foreground + nonforeground, foreground = allocated + unknown."""
    us = F.col("end_us") - F.col("start_us")
    when = lambda c: F.sum(F.when(c, us).otherwise(0))
    named = F.col("tier").isin("user_confirmed_label", "model_inference")
    away = F.col("tier") == "nonforeground"
    return pieces.groupBy(*keys).agg(F.sum(us).alias("observed_us"), when(~away).alias("foreground_us"), when(away).alias("nonforeground_us"), when(named).alias("allocated_us"), when(~away & ~named).alias("unknown_us"))


def user_label_totals(corrections: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Unknown time inside confirmed scopes, by label."""
    met = overlap_join(corrections.select(*keys, "start_us", "end_us", "label"), runs.where("state = 'unattributed'").select(*keys, "start_us", "end_us"), keys)
    return met.groupBy(*keys, "label").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
