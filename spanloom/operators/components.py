"""Joins on hot keys, and connected components by alternating stars: no key's rows are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.scratch import removed, written

#: Keys that meet() takes for hot at most, and rows that make a key hot at least.
HOT, LEAST_HOT = 1 << 16, 1000


def meet(rows: DataFrame, stats: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined by a long key to stats, which has one row a key and in `count` how many rows have it, of `total` in all.

    Keys with more than total / HOT rows, fewer than HOT of them, are broadcast; their rows are dealt by a hash of all
    their columns, the others by key. So no task gets all rows of a hot key.
    """
    many = max(LEAST_HOT, total // HOT)
    values = [c for c in stats.columns if c != key]
    hot = stats.where(F.col(count) > many).select(key, F.struct(*values).alias("__hot"))
    cold = stats.where(F.col(count) <= many).select(F.lit(True).alias("__is_cold"), F.col(key).alias("__key"), F.struct(*values).alias("__cold"))
    told = rows.join(F.broadcast(hot), key, "left")
    none = F.col("__hot").isNull()
    met = told.withColumns({"__is_cold": none, "__key": F.when(none, F.col(key)).otherwise(F.xxhash64(*rows.columns))}).join(cold, ["__is_cold", "__key"], "left")
    found = F.coalesce("__hot", "__cold")
    return met.where(found.isNotNull()).select(*rows.columns, *[found[v].alias(v) for v in values])


def _shape(edges: DataFrame) -> tuple[int, int]:
    """How many edges (u, v) there are, and how many nodes keep them from being stars: a u of two edges, or one that is a v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 OR (up = 1 AND down = 1)"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges with the least v of each u as m; edges of a node with very many are dealt to all tasks."""
    return meet(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "u", "n", total)


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node that has a smaller one in its component; root is the component's smallest node.

    `edges` has two long columns u and v; loops, repeats and either direction are fine. Nodes without edges, and the
    roots themselves, have no row. Rounds go on until all edges are stars, which one count tells; each is written to the
    shared folder in place of the one before, so lost executors cost one round.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    total, left = _shape(e)
    while left:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")))  # as many rows as e
        down = _with_least(large, 2 * total)
        new = written(down.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        removed(e, large)
        e = new
        total, left = _shape(e)
    return e.select("u", F.col("v").alias("root"))
