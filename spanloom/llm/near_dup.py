"""Near-duplicate documents by HyperMinHash.

1. Each text's shingle set gives a fingerprint and a sketch: in each of 128 buckets the least hash, kept as its leading
   zero count and the mantissa bits after the first one. Texts with one set are one class with one representative.
2. Bands of 4 registers bring representatives together. Within a bucket, those whose estimated similarity, corrected
   for chance collisions of registers, comes near the threshold are joined to families; only the joins of a spanning
   forest leave the task. Buckets with the same members count once.
3. Families meet again with their texts, and links are confirmed on the full sets; again only a spanning forest leaves.
   Every pair that meets in a bucket and passes the estimate is in one family, so no confirmed link is lost here.

A large bucket or family is dealt out in blocks, and its least member, the pivot, comes to each of them. Members that this
joins to the pivot need no more comparing with each other: only the rest meets all blocks, in pairs of blocks. So a large
group of copies costs one pass, and no pair of members is left out that could still join something.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 1e-7 (at 0.85: 1e-10), and fails the estimate, 5 standard
deviations below the threshold, with probability below 1e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import empty_text, give_back, groups, key_filter, partitions, passing, ready, slices, starts, utf8, written
from spanloom.operators.components import components, meet

WORDS = 5
BUCKET_BITS, MANTISSA = 7, 10
REGISTERS = 1 << BUCKET_BITS
BAND = 4
#: Members of a block, and shingles in it: larger buckets and families are dealt out in blocks.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
DEVIATIONS = 5.0
STRETCH = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some texts, A-Z lower-cased, and where its first byte lies."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = _BLANK[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[ends[(ends >= 0) & (ends <= len(data))]] = True
    before = np.append(True, blank[:-1])
    after = np.append(blank[1:], True)
    begin = np.flatnonzero(~blank & (before | first[:-1]))
    end = np.flatnonzero(~blank & (after | first[1:])) + 1
    sums = np.cumsum(_BYTE[_LOWER[data]] * _powers(_BASE, len(data)), dtype=np.uint64)
    sums = np.append(np.uint64(0), sums)
    return _mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(data))[begin] + (end - begin).astype(np.uint64)), begin


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of an Arrow column, sorted within a text, and the texts' offsets."""
    data, ends = utf8(column)
    n = len(column)
    if len(data) <= STRETCH:
        words, begin = _words(data, ends)
    else:  # a long text in stretches that end at white space
        parts, at = [], 0
        while at < len(data):
            to = min(at + STRETCH, len(data))
            if to < len(data):
                blank = np.flatnonzero(_BLANK[data[at:to]])
                rest = np.flatnonzero(_BLANK[data[to:]]) if not len(blank) else blank
                to = at + int(blank[-1]) + 1 if len(blank) else (to + int(rest[0]) + 1 if len(rest) else len(data))
            w, b = _words(data[at:to], ends - at)
            parts.append((w, b + at))
            at = to
        words, begin = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner = np.searchsorted(ends, begin, side="right") - 1
    count = np.bincount(owner, minlength=n)[:n] if len(owner) else np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        if len(words) >= WORDS:
            m = len(words) - WORDS + 1
            total = np.zeros(m, np.uint64)
            for k in range(WORDS):
                total += words[k : k + m] * _PLACE[k]
            inside = owner[:m] == owner[WORDS - 1 :]
            h, who = _mix(total[inside]), owner[:m][inside]
        else:
            h, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):  # the whole sequence is the one shingle
            at = np.searchsorted(owner, short)
            few = np.zeros(len(short), np.uint64)
            for k in range(WORDS - 1):
                has = count[short] > k
                few[has] += words[at[has] + k] * _PLACE[k]
            h, who = np.concatenate([h, _mix(few + count[short].astype(np.uint64) * _PLACE[8], 3)]), np.concatenate([who, short])
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[new], who[new]
    return h, np.searchsorted(who, np.arange(n + 1))


def sketch(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers of each text: 0 for an empty bucket, else 1 + leading zeros and mantissa of the bucket's least hash."""
    n = len(at) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    if not len(h):
        return out
    who = np.repeat(np.arange(n), np.diff(at))
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(h), dtype=bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1])
    low = (h[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)).astype(np.float64) + 1.0
    fraction, exponent = np.frexp(low)
    zeros = np.clip(64 - BUCKET_BITS - exponent, 0, 61)
    mantissa = ((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    out[who[first], bucket[first]] = (zeros << MANTISSA | mantissa) + 1
    return out


def _fold(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return (sums[at[1:]] - sums[at[:-1]]).astype(np.int64)


def _sign(batches):
    give_back()
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = shingles(part.column("text"))
                s = sketch(h, at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(_fold(_mix(h, 1), at)), pa.array(_fold(_mix(h, 2), at)), pa.array([x.tobytes() for x in s], pa.binary())],
                    ["doc_id", "n_shingles", "fa", "fb", "sketch"],
                )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, fa, fb, sketch): size, fingerprint and registers of each document's shingle set."""
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text")).mapInArrow(_sign, "doc_id long, n_shingles long, fa long, fb long, sketch binary")


def _bands(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
            keys = s.view(np.uint64).reshape(batch.num_rows, REGISTERS // BAND)
            node = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            band = np.tile(np.arange(keys.shape[1], dtype=np.uint64), batch.num_rows)
            full = keys.ravel() != 0
            key = _mix(_mix(keys.ravel()) + band).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[full]), pa.array(key[full])], ["node", "key"])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs of register rows, less the chance collisions of registers, and the buckets in use."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    big, small = np.maximum(na, nb), np.maximum(1, np.minimum(na, nb))
    ratio = big / small
    chance = 0.169919487159739093975315012348 * used * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0.0, (same - chance) / np.maximum(1, used)), used


def _near(a, b, na, nb, least: float) -> np.ndarray:
    value, used = estimate(a, b, na, nb)
    return value >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(1, used)) - 1e-9


def _labels(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each can reach over pairs of places a, b."""
    label = nodes.copy()
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == label).all():
            break
        label = new
    return label


def _pairs(at: np.ndarray, most: int):
    """Pairs of places within groups of at most `most` rows, some at a time."""
    rows = np.repeat(np.diff(at), np.diff(at))
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))
    small = rows <= most
    for d in range(1, int(rows[small].max(initial=1))):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        if len(i):
            yield i, i + d


def _families(least: float):
    def run(batches):
        for t in groups(batches, ["key", "i", "j"]):
            at = starts(t, ["key", "i", "j"])
            nodes, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(t.num_rows, REGISTERS)
            left, right = [], []
            for i, j in _pairs(at, 32):
                ok = _near(s[i], s[j], n[i], n[j], least)
                left.append(i[ok]), right.append(j[ok])
            for g in np.flatnonzero(np.diff(at) > 32):
                lo, hi = at[g], at[g + 1]
                for k in range(lo, hi, 32):
                    m = min(k + 32, hi)
                    ok = _near(s[k:m, None], s[None, k:hi], n[k:m, None], n[None, k:hi], least)
                    i, j = np.nonzero(ok)
                    up = j > i
                    left.append(i[up] + k), right.append(j[up] + k)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            label = _labels(nodes, a, b)
            moved = label != nodes
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(label[moved])], ["u", "v"])

    return run


def _links(percent: int):
    """Pairs of a family with 100 * intersection >= percent * union, from the full sets."""

    def linked(h: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(at[lo : hi + 1])
        own = h[at[lo] : at[hi]]
        if hi - lo == 2:
            both = len(np.intersect1d(own[: sizes[0]], own[sizes[0] :], assume_unique=True))
            ok = 100 * both >= percent * (sizes.sum() - both)
            return (np.array([lo]), np.array([lo + 1])) if ok else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        who = np.repeat(np.arange(hi - lo), sizes)
        _, column, count = np.unique(own, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        who, column = who[shared], column[shared]
        order = np.argsort(column, kind="stable")
        who, column = who[order], column[order]
        rank = np.cumsum(np.append(0, column[1:] != column[:-1])) if len(column) else column
        both = np.zeros((hi - lo, hi - lo), np.float64)
        width = 4096
        for c in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
            x, y = np.searchsorted(rank, [c, c + width])
            part = np.zeros((hi - lo, width), np.float32)
            part[who[x:y], rank[x:y] - c] = 1
            both += part @ part.T
        union = sizes[:, None] + sizes[None, :] - both
        i, j = np.nonzero(np.triu(100 * both >= percent * union, 1))
        return i + lo, j + lo

    def run(batches):
        with np.errstate(over="ignore"):
            for t in groups(batches, ["root", "i", "j"], 256):
                at = starts(t, ["root", "i", "j"])
                nodes = t.column("node").to_numpy()
                parts = [shingles(p.column("text")) for b in t.to_batches() for p in slices(b, "text")]
                h = np.concatenate([p[0] for p in parts])
                sizes = np.concatenate([np.diff(p[1]) for p in parts])
                ends = np.append(0, np.cumsum(sizes))
                found = [linked(h, ends, at[g], at[g + 1]) for g in np.flatnonzero(np.diff(at) > 1)]
                a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                label = _labels(nodes, a, b)
                moved = label != nodes
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(label[moved])], ["u", "v"])

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """members (key, node, n, pivot, blocks) with block columns i and j, j always 0: each in its own, the pivot in all."""
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return members.select("key", F.explode(F.when(F.col("node") == F.col("pivot"), every).otherwise(own)).alias("i"), F.lit(0).cast("long").alias("j"), "node")


def _pairs_of_blocks(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Members of groups of several blocks that are not all joined to their pivot by labels (u, root), with columns i
    and j: the rest in all pairs of its block with another, those with the pivot in pairs with a block of the rest.
    None if there are none.
    """
    large = members.where("blocks > 1")
    if large.isEmpty():
        return None
    root = lambda c: labels.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
    pivots = large.groupBy("key").agg(F.first("pivot").alias("pivot"), F.count(F.lit(1)).alias("rows")).join(root("pivot"), "pivot", "left")
    pivots = pivots.select("key", "rows", F.coalesce("pivot_root", "pivot").alias("lead"))
    own = large.join(root("node"), "node", "left").select("key", "node", "n", F.coalesce("node_root", "node").alias("own"))
    total = large.count()
    told = written(meet(own, pivots, "key", "rows", total).select("key", "node", "n", (F.col("own") == F.col("lead")).alias("same")))
    blocks = lambda of: F.greatest(F.ceil(F.count_if(of) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("long")
    sizes = told.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), blocks(~F.col("same")).alias("rest"), blocks(F.col("same")).alias("joined")).where("rest > 0")
    if sizes.isEmpty():
        return None
    met = meet(told, sizes, "key", "rows", total)
    place = F.when(F.col("same"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("joined"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest")))
    others = F.sequence(F.lit(0).cast("long"), F.col("rest") - 1 + F.when(F.col("same"), 0).otherwise(F.col("joined")))
    met = met.withColumn("own", place).withColumn("other", F.explode(others))
    return met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")


def _joined(members: DataFrame, pairs) -> DataFrame:
    """Components (u, root) of what pairs(members in blocks) finds: first by block, then in pairs of blocks for the rest."""
    labels = components(pairs(_blocks(members)))
    rest = _pairs_of_blocks(members, labels)
    return labels if rest is None else components(labels.withColumnRenamed("root", "v").unionByName(pairs(rest)))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set has the distinct shingles of five words, of a
    text with fewer words its whole sequence, of a text without words (or a null text) nothing. Documents are linked if
    100 * intersection >= percent * union of their sets; component_id is the smallest doc_id that links reach, the
    document's own without any, and kept says whether it is the document's own. Rows that share a doc_id count as one
    document in this; a null doc_id links nothing, has a null component and is kept. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    least = percent / 100
    signed = written(signatures(docs, id_col, text_col))
    alike = ["fa", "fb", "n_shingles"]
    classes = written(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*alike).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")))
    bands = classes.select("node", "sketch").mapInArrow(_bands, "node long, key long")
    # Buckets with at least two members; of those with the same members, one.
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("pivot")).where("size > 1")
    buckets = written(buckets.groupBy("size", "who").agg(F.min("key").alias("key"), F.min("pivot").alias("pivot")).select("key", "size", "pivot"))
    total = buckets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    members = meet(passing(bands, "key", key_filter(buckets, "key")), buckets, "key", "size", total)
    members = written(members.select("key", "node", F.lit(0).cast("long").alias("n"), "pivot", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")))
    sketches = passing(classes.select("node", F.col("n_shingles").alias("n"), "sketch"), "node", key_filter(members, "node"))
    tasks = partitions(spark)

    def alike_pairs(met: DataFrame) -> DataFrame:
        near = met.join(sketches, "node").select("key", "i", "j", "node", "n", "sketch")
        return near.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_families(least), "u long, v long")

    families = _joined(members, alike_pairs)
    families = families.unionByName(families.select(F.col("root").alias("u"), "root").distinct())
    families = written(families.select(F.col("u").alias("node"), F.col("root").alias("key")).join(classes.select("node", F.col("n_shingles").alias("n")), "node"))
    sizes = families.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    members = meet(families, sizes, "key", "size", families.count())
    members = written(members.select("key", "node", "n", F.col("key").alias("pivot"), F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks")))
    texts = passing(docs.select(F.col(id_col).cast("long").alias("node"), empty_text(text_col).alias("text")), "node", key_filter(families, "node"))

    def confirmed_pairs(met: DataFrame) -> DataFrame:
        found = texts.join(met, "node").select(F.col("key").alias("root"), "i", "j", "node", "text")
        return found.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_links(percent), "u long, v long")

    links = _joined(members, confirmed_pairs)
    roots = classes.select(*alike, "node").join(links.select(F.col("u").alias("node"), "root"), "node", "left").select(*alike, F.coalesce("root", "node").alias("component_id"))
    return signed.select("doc_id", *alike).join(roots, alike, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.coalesce("component_id", "doc_id")).otherwise(F.lit(True)).alias("kept"),
    )
