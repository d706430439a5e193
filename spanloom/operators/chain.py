"""Chains through numbered rows whose next step is known: followed by pointer doubling, inside lots and then over lots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.sources.scratch import removed, written

#: Rows of one lot, a power of two: its pointers are one array.
LOT = 1 << 13


def _at(rows: Column, n: Column, low: Column) -> Column:
    """What an array that begins with row `low` has for row n, null beyond its end."""
    return F.get(rows, F.least(n - low, F.size(rows).cast("long")).cast("int"))


def _doubled(jump: Column, low: Column) -> Column:
    """Pointers of twice as many steps; one that has left the lot stays."""
    return F.transform(jump, lambda x: F.coalesce(_at(jump, x, low), x))


def _same(keys: list[str]) -> Column:
    """Whether keys equal those named with two underscores before them; a null key is a key like any."""
    return reduce(lambda s, k: s & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True))


def _met(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """a's keys and e beside b's x, where a.left = b.right in the same keys."""
    named = b.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(right).alias("__at"), F.col("x").alias("__x"))
    return a.join(named, _same(keys) & (F.col(left) == F.col("__at"))).select(*keys, "e", F.col("__x").alias("x"))


def _entries(lots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, e): the first row of each lot that the chain from row 1 meets, found in as many rounds as lots have bits."""
    exits = F.aggregate(F.sequence(F.lit(1), F.lit(LOT.bit_length() - 1)), F.transform("rows", lambda r: r.next), lambda jump, _: _doubled(jump, F.col("low")))
    last = lots.groupBy(*keys).agg(F.max(F.col("low") + F.size("rows") - 1).alias("last")).withColumnsRenamed({k: f"__{k}" for k in keys})
    told = lots.join(last, _same(keys)).select(*keys, "lot", "low", "last", exits.alias("exits"))
    met = told.select(*keys, F.explode(F.array_distinct("exits")).alias("e")).select(*keys, F.floor((F.col("e") - 1) / LOT).alias("lot"), "e")
    asked = met.unionByName(lots.where("lot = 0").select(*keys, "lot", F.lit(1).cast("long").alias("e")))
    asked = asked.groupBy(*keys, "lot").agg(F.collect_set("e").alias("es")).withColumnsRenamed({c: f"__{c}" for c in [*keys, "lot"]})
    steps = told.join(asked, _same([*keys, "lot"])).select(*keys, "last", "exits", "low", F.explode("es").alias("e"))
    steps = steps.select(*keys, "e", _at(F.col("exits"), F.col("e"), F.col("low")).alias("x"), "last")
    jumps = [written(steps.where("x <= last").drop("last"))]
    while not jumps[-1].isEmpty():
        jumps.append(written(_met(jumps[-1], jumps[-1], keys, "x", "e")))
    reached = written(lots.where("lot = 0").select(*keys, F.lit(1).cast("long").alias("e")))
    for jump in reversed(jumps[:-1]):
        more = written(reached.unionByName(_met(reached, jump, keys, "e", "e").select(*keys, F.col("x").alias("e"))))
        removed(reached)
        reached = more
    removed(*jumps)
    return reached


def followed(steps: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, n, next, values) of the rows that the chain from row 1 meets.

    `steps` has n, from 1 without holes by keys, and next > n, the row that follows if this one is met; a next beyond the
    last row ends the chain. Rows come in lots of LOT: inside one, pointers are doubled as arrays; over lots, only rows at
    which some chain leaves the lot before are doubled by joins, a round written at a time. So keys of any length are
    dealt to all tasks, and rounds grow with the logarithm of their lots. No rows give no rows.
    """
    rows = steps.withColumn("lot", F.floor((F.col("n") - 1) / LOT)).groupBy(*keys, "lot").agg(F.sort_array(F.collect_list(F.struct("n", "next", *values))).alias("rows"))
    lots = written(rows.withColumn("low", F.col("lot") * LOT + 1))
    if (lots.agg(F.max("lot")).first()[0] or 0) == 0:
        begun = lots.withColumn("e", F.lit(1).cast("long"))
    else:
        entries = _entries(lots, keys).withColumn("lot", F.floor((F.col("e") - 1) / LOT)).withColumnsRenamed({c: f"__{c}" for c in [*keys, "lot"]})
        begun = lots.join(entries, _same([*keys, "lot"]))
    low = F.col("low")
    jumps = F.aggregate(F.sequence(F.lit(1), F.lit(LOT.bit_length() - 2)), F.array(F.transform("rows", lambda r: r.next)), lambda js, _: F.concat(js, F.array(_doubled(F.element_at(js, -1), low))))
    inside = lambda j, ns: F.filter(F.transform(ns, lambda n: _at(j, n, low)), lambda n: n - low < F.size(j))
    met = F.aggregate(F.reverse(jumps), F.array("e"), lambda ns, j: F.concat(ns, inside(j, ns)))
    found = begun.select(*keys, F.explode(F.transform(met, lambda n: _at(F.col("rows"), n, low))).alias("r"))
    return found.select(*keys, *[F.col(f"r.{c}").alias(c) for c in ["n", "next", *values]])
