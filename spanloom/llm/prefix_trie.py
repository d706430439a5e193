"""The trie of conversations' prefixes, with totals of subtrees by centroid decomposition.

A node is a distinct sequence of first turns. It is named by its smallest conversation and its depth; a conversation's path
through the trie is its own row at each depth. A prefix's digest is the exclusive or of digests of (depth, turn), so it is a
running sum, and long conversations are cut into stretches whose sums are carried on.

Totals of subtrees come in rounds. Each component of what is left has a weight by node, the turns of its members from there
on, which is known without a walk. The centroid is the deepest node that still has the component's leading power of two of
weight; taken out, it leaves components of less than that power: one below each child, and what is above and beside. The
component's totals below the centroid are its own result, and are added along the path from it to the component's top. So a
chain of a million turns takes twenty rounds, not a million.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, ready, removed, scratch, written

#: Turns of a conversation in one stretch, and ids of members in one text of a node's list.
STRETCH, IDS = 512, 4096


def numbered(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with `pos`, from 1 in order of turn (nulls first), role and text.

    Rows are dealt by range of that order, so that a conversation of any length lies in as many tasks as it needs; equal
    rows are one with a count until they are numbered.
    """
    order = ["conv_id", "turn", "role", "text"]
    once = turns.groupBy(*order).agg(F.count(F.lit(1)).alias("copies"))
    ranged = written(once.repartitionByRange(partitions(turns.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("conv_id", "part").agg(F.sum("copies").alias("size"))
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(before("conv_id").orderBy("part")), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("copies").over(before("conv_id", "part").orderBy("turn", "role", "text")), F.lit(0))
    placed = ranged.withColumn("own", own).join(sizes, ["conv_id", "part"])
    first = F.col("base") + F.col("own")
    return placed.withColumn("pos", F.explode(F.sequence(first + 1, first + F.col("copies")))).select(*order, "pos")


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their family's first one.

    Conversation c begins with the first h turns of c - c % family (all if fewer, none if absent), then come its own turns
    after its first h; h is the unsigned crc32 of decimal c, modulo most + 1. Gives turns (conv_id, depth from 1, a, b, bytes,
    size), a and b being digests of role and text, and all conversations (conv_id, size), also those without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = numbered(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")))
    turns = written(turns.select("conv_id", "pos", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.octet_length("text").cast("long").alias("bytes")))
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"first": F.col("conv_id") - F.col("conv_id") % family, "h": h})
    of_first = sizes.select(F.col("conv_id").alias("first"), F.col("own").alias("has"))
    shared = F.least("h", F.coalesce("has", F.lit(0)))
    each = sizes.join(of_first, "first", "left").withColumn("shared", shared)
    each = written(each.withColumn("size", F.col("shared") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).select("conv_id", "first", "h", "shared", "size"))
    heads = turns.where((F.col("pos") <= most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "first")
    own = heads.join(each, "first").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "a", "b", "bytes", "size")
    rest = turns.join(each, "conv_id").where("pos > h").select("conv_id", (F.col("shared") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "bytes", "size")
    return own.unionByName(rest), each.select("conv_id", "size")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the digest (p1, p2) of the prefix that it ends, and of the one before (q1, q2)."""
    digest = {f"x{i}": F.xxhash64(F.lit(i), "depth", "a", "b") for i in (1, 2)}
    told = turns.withColumns(digest | {"part": F.floor((F.col("depth") - 1) / STRETCH)})
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = told.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    carried = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"y{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    run = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    told = told.join(carried, ["conv_id", "part"]).withColumns({f"p{i}": F.bit_xor(f"x{i}").over(run).bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)})
    return told.select("conv_id", "depth", "bytes", "size", "p1", "p2", *[F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)])


def _digests(batches):
    """SHA-256 by node of its members' ids, out of texts of ids in order; a node's state passes from batch to batch."""
    at, state = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if key == at:
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                done.append((*at, state.hexdigest()))
            at, state = key, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["conv_id", "depth", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes, of (member, conv_id, depth) rows of the conversations that end there."""
    part = F.floor(F.col("member") / IDS).alias("part")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",")
    texts = members.groupBy("conv_id", "depth", part).agg(ids.alias("ids"))
    return texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def _shared(rows: DataFrame, nodes: DataFrame, root: int) -> DataFrame:
    """Of conversations that name a node: at each depth above their first own node, who names the node there, and the next.

    Rows (conv_id, depth, by, next); from its first own node on, a conversation names all nodes of its path.
    """
    first = nodes.groupBy("conv_id").agg(F.min("depth").alias("own"))
    above = rows.join(first, "conv_id").where("depth < own").select("conv_id", "depth", "p1", "p2", "own")
    named = above.join(nodes.select("depth", "p1", "p2", F.col("conv_id").alias("by")), ["depth", "p1", "p2"]).select("conv_id", "depth", "by", "own")
    named = written(named.unionByName(first.where("own > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("by"), "own")))
    below = named.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("by").alias("after"))
    return named.join(below, ["conv_id", "depth"], "left").select("conv_id", "depth", "by", F.coalesce("after", "conv_id").alias("next"))


def subtree_totals(nodes: DataFrame, shared: DataFrame, values: list[str]) -> DataFrame:
    """Sums of `values` over the subtree of each node, itself included: (conv_id, depth, values).

    nodes: (conv_id, depth, weight, values), weight being the sum over the subtree of any positive number by node; shared
    as _shared() gives it. Rounds go on until no node is left: as many as the root's weight has bits, at most. Each is
    written to the shared folder in place of the one before.
    """
    spark = nodes.sparkSession
    base, kept = scratch(spark), ["conv_id", "depth", "weight", *values]
    more = [f"more_{v}" for v in values]
    top = nodes.agg(F.min("conv_id").alias("c")).first().c
    state = written(nodes.select(*kept, *[F.lit(0).cast("long").alias(m) for m in more], F.lit(top).cast("long").alias("of"), F.lit(0).cast("long").alias("of_depth")))
    known = written(shared.select(F.col("conv_id").alias("k_conv"), F.col("depth").alias("k_depth"), "by", "next"))
    n = 0
    while state.count():
        least = F.min(F.struct((-F.length(F.bin("weight"))).alias("bits"), "weight", "conv_id", "depth")).alias("c")
        centroids = state.groupBy("of", "of_depth").agg(least).select("of", "of_depth", F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"))
        below, above = F.col("depth") > F.col("c_depth"), F.col("depth") < F.col("c_depth")
        asked = state.join(centroids, ["of", "of_depth"]).withColumns({"k_conv": F.when(below, F.col("conv_id")).otherwise(F.col("c_conv")), "k_depth": F.least("depth", "c_depth")})
        met = asked.join(known, ["k_conv", "k_depth"], "left").withColumns({"by": F.coalesce("by", "k_conv"), "next": F.coalesce("next", "k_conv")})
        own = (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv"))
        side = F.when(own, "centroid").when(below & (F.col("by") == F.col("c_conv")), "below").when(above & (F.col("by") == F.col("conv_id")), "path").otherwise("beside")
        told = written(met.withColumn("side", side).drop("k_conv", "k_depth", "by"))
        sums = told.where("side IN ('centroid', 'below')").groupBy("of", "of_depth").agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
        added = told.where("side IN ('centroid', 'path')").join(sums, ["of", "of_depth"]).withColumns({m: F.col(m) + F.col(f"sum_{v}") for v, m in zip(values, more, strict=True)})
        added = written(added.drop(*[f"sum_{v}" for v in values]))
        added.where("side = 'centroid'").select("conv_id", "depth", *[F.col(m).alias(v) for v, m in zip(values, more, strict=True)]).write.parquet(f"{base}/round={n}")
        path = added.where("side = 'path'").withColumn("weight", F.col("weight") - F.col("c_weight"))
        low = F.col("side") == "below"
        rest = told.where("side IN ('below', 'beside')").withColumns({"of": F.when(low, F.col("next")).otherwise(F.col("of")), "of_depth": F.when(low, F.col("c_depth") + 1).otherwise(F.col("of_depth"))})
        after = written(rest.unionByName(path).select(state.columns))
        removed(state, told, added)
        state, n = after, n + 1
    removed(state, known)
    return spark.read.schema(nodes.select("conv_id", "depth", *values).schema).parquet(base).select("conv_id", "depth", *values)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of turns' prefixes, from the root, of no turns.

    turns: (conv_id, depth, a, b, bytes, size), a and b naming what is equal in equal turns; conversations: (conv_id, size),
    also those of size 0. Gives conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (sum over the subtree of (n_convs - 1) * bytes) and ends_sha256 (of the ids of members of just
    this depth). No conversations give no rows. Prefixes of two equal 64-bit digests would be one node.
    """
    size = conversations.agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("size") + 1).alias("w")).first()
    spark = ready(turns.sparkSession)
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not size.n:
        return spark.createDataFrame([], out)
    rows = written(_prefixes(turns))
    zero = F.lit(0).cast("long")
    root = conversations.limit(1).select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit(size.c).cast("long").alias("conv_id"), F.lit(size.n).cast("long").alias("n_convs"), F.lit(size.w).cast("long").alias("weight"), zero.alias("bytes"), zero.alias("q1"), zero.alias("q2"))
    nodes = rows.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("size") - F.col("depth") + 1).alias("weight"), F.max("bytes").alias("bytes"), F.max("q1").alias("q1"), F.max("q2").alias("q2")
    )
    nodes = written(nodes.unionByName(root))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    with_parent = nodes.join(parents, ["depth", "q1", "q2"], "left")
    children = with_parent.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = written(with_parent.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    leaf = (F.col("n_children") == 0).cast("long")
    sums = subtree_totals(whole.select("conv_id", "depth", "weight", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), _shared(rows, nodes, size.c), ["n_leaves", "saved_tokens"])
    last = rows.where("depth = size").select(F.col("conv_id").alias("member"), "depth", "p1", "p2").join(nodes.select("depth", "p1", "p2", "conv_id"), ["depth", "p1", "p2"]).select("member", "conv_id", "depth")
    turnless = conversations.where("size = 0").select(F.col("conv_id").alias("member"), F.lit(size.c).cast("long").alias("conv_id"), zero.alias("depth"))
    ends = _ends(last.unionByName(turnless))
    found = whole.join(sums, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """trie() of rebuilt() conversations (conv_id, turn, role, text).

    Null roles and texts count as empty, null turns come first, and turns that tie are in order of role and text; rows that
    repeat are turns of their own. Rows of a null conv_id take no part. Empty tables give no rows. Other columns are ignored.
    """
    turns, each = rebuilt(conversations, family, most)
    return trie(turns, each)
