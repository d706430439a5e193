"""Evidence of frames: why one is out, what they reach, and codes that differ in few bits."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(out)
    return out


def reach(anchors: DataFrame, radius_us: int, slot_us: int) -> DataFrame:
    """By device: valid anchors, distinct slots and seconds (the union of radius_us around each, found by day)."""
    from spanloom.operators.interval import by_day, union_us

    spans = anchors.select("device", (F.col("at_us") - radius_us).alias("start_us"), (F.col("at_us") + radius_us).alias("end_us"))
    counted = anchors.groupBy("device").agg(F.count(F.lit(1)).alias("anchors"), F.count_distinct(F.floor(F.col("at_us") / slot_us)).alias("slots"))
    united = union_us(by_day(spans), ["device", "day"], "us").groupBy("device").agg(F.sum("us").alias("reach_us"))
    return counted.join(united, "device")


#: Keys of one code at most.
KEYS = 70


def block_choices(most: int, bits: int = 64) -> list[tuple[tuple[int, int], ...]]:
    """Choices of blocks (first bit, width) of which two codes that differ in `most` bits or fewer agree in one at least.

    Of b blocks such codes agree in b - most; each choice is so many of them. More blocks make longer keys, which fewer
    unequal codes share: as many blocks as KEYS choices allow, 2 * most at most, whose keys have half of all bits.
    """
    blocks = max(b for b in range(most + 1, max(2 * most, most + 1) + 1) if b == most + 1 or comb(b, most) <= KEYS)
    edges = [i * bits // blocks for i in range(blocks + 1)]
    return [tuple((edges[i], edges[i + 1] - edges[i]) for i in chosen) for chosen in combinations(range(blocks), blocks - most)]


def hamming_pairs(codes: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """Pairs (a, b) of codes (id, code) that differ in at most `most` bits, each once.

    An equi-join on choices of blocks (see block_choices) finds all: for 4 of 64 bits that is 70 keys of 32 bits, so that
    N codes at random make about N * N * 35 / 2^32 pairs to look at.
    """
    masks = [sum(((1 << width) - 1) << first for first, width in chosen) for chosen in block_choices(most, bits)]
    # A choice's key is the code with all other bits cleared; as one list of masks it keeps plans small.
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    told = codes.select("id", "code", F.posexplode(signed).alias("n", "m")).select("id", "code", "n", F.col("code").bitwiseAND(F.col("m")).alias("v"))
    other = told.select(F.col("id").alias("b"), F.col("code").alias("c2"), "n", "v")
    near = told.withColumnRenamed("id", "a").join(other, ["n", "v"]).where("a < b")
    return near.where(F.bit_count(F.col("code").bitwiseXOR(F.col("c2"))) <= most).select("a", "b").distinct()
