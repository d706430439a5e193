"""Hard negatives: rows of another label that are like an anchor, but less so than its positives.

Pairs of an anchor and a row are packed into keys (anchor, descending score, positives first, id), dealt by anchor and
sorted in the shuffle. One stream over a partition opens a window for each of an anchor's first positives and gives each
window the negatives that follow in it, with nothing of an anchor in memory but its open windows.

Before the shuffle, a task keeps what its own rows can add: positives among its best, and in each window its first
negatives. Anchors are asked in blocks of a fixed size; each block's keys are written before the next one begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, ready, removed, scratch, written
from spanloom.llm.topk import CHUNK, _matrix, _scores, quantised

ANCHORS_PER_BLOCK = 4096
#: Scores below this in size keep their order when a chunk's row number is added to them.
MOST_SCORE = 1 << 52
_NONE = -(1 << 62)


class _Best:
    """The first k (score, id) of each row of a matrix of scores, chunk by chunk; ties go to the smaller id."""

    def __init__(self, rows: int, k: int):
        self.k, self.score, self.id = k, np.full((rows, k), _NONE), np.zeros((rows, k), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> None:
        """scores of all rows and of a chunk whose ids ascend; only those of the mask count."""
        mask = mask & (scores >= self.score[:, -1:])
        rows = np.flatnonzero(mask.any(axis=1))
        if not len(rows):
            return
        key = np.where(mask[rows], scores[rows] * CHUNK + (CHUNK - 1 - np.arange(len(ids))), _NONE)
        if key.shape[1] > self.k:
            key = np.partition(key, key.shape[1] - self.k, axis=1)[:, -self.k :]
        has = key > _NONE
        score = np.where(has, key // CHUNK, _NONE)
        found = np.where(has, ids[np.where(has, CHUNK - 1 - key % CHUNK, 0)], 0)
        score, found = np.concatenate([self.score[rows], score], axis=1), np.concatenate([self.id[rows], found], axis=1)
        order = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matrix row, score, id, and how many equal ones come before, of all that there is."""
        again = np.zeros(self.id.shape, np.int64)
        for i in range(1, self.k):
            same = (self.score[:, i] == self.score[:, i - 1]) & (self.id[:, i] == self.id[:, i - 1])
            again[:, i] = np.where(same, again[:, i - 1] + 1, 0)
        at, place = np.nonzero(self.score > _NONE)
        return at, self.score[at, place], self.id[at, place], again[at, place]


def _chunks(block, batches):
    """Ids that ascend, scores with all anchors, and whether a row is of the anchor's label and not the anchor's own."""
    ids, labels, vectors = block
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = pa.Table.from_batches([batch.slice(at, CHUNK)]).sort_by("id").combine_chunks()
            own, label = part.column("id").to_numpy(), part.column("label").to_numpy()
            scores = _scores(vectors, _matrix(part.column("v").chunk(0)))
            if len(own) and np.abs(scores).max() >= MOST_SCORE:
                raise ValueError("scores of 2^52 or more")
            other = ids[:, None] != own[None, :]
            alike = labels[:, None] == label[None, :]
            yield own, scores, other & alike, other & ~alike


_BEST = "q int, score long, id long"


def _positives(block, k: int):
    """The best k rows of an anchor's own label in a task."""

    def run(batches):
        best = _Best(len(block.value[0]), k)
        for ids, scores, alike, _ in _chunks(block.value, batches):
            best.add(scores, ids, alike)
        at, score, found, _ = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(score), pa.array(found)], ["q", "score", "id"])

    return run


def bounds(score, low: int, high: int):
    """Least and highest negative score of a positive's window: low to high per cent of its score."""
    return -(-low * score // 100), high * score // 100


def _packed(block, windows, positives: int, negatives: int):
    """Keys of an anchor's positives in a task, and of the first negatives in each of its windows."""

    def run(batches):
        ids = block.value[0]
        last, least, most = windows.value
        best, held = _Best(len(ids), positives), [_Best(len(ids), negatives) for _ in range(positives)]
        for own, scores, alike, other in _chunks(block.value, batches):
            best.add(scores, own, alike & (scores >= last[:, None]))
            for p, window in enumerate(held):
                window.add(scores, own, other & (scores >= least[:, p, None]) & (scores <= most[:, p, None]))
        # A row in several windows of an anchor is one key; rows that repeat stay as many.
        found = np.unique(np.stack([np.concatenate(x) for x in zip(*(w.rows() for w in held), strict=True)]), axis=1)
        at, score, near, _ = best.rows()
        q = np.concatenate([at, found[0]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[q]), pa.array(np.concatenate([score, found[1]])), pa.array(np.repeat([0, 1], [len(at), found.shape[1]]).astype(np.int32)), pa.array(np.concatenate([near, found[2]]))],
            ["anchor_id", "score", "kind", "id"],
        )

    return run


def _asked(candidates: DataFrame, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, positives: int, negatives: int, low: int, high: int, path: str) -> None:
    """Writes the keys of one block of anchors."""
    spark = candidates.sparkSession
    block = spark.sparkContext.broadcast((ids, labels, vectors))  # at most ANCHORS_PER_BLOCK vectors
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    first = candidates.mapInArrow(_positives(block, positives), _BEST).withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives)
    found = first.select("q", "place", "score").toPandas()  # at most `positives` rows by anchor of the block
    last, score = np.full(len(ids), -_NONE), np.full((len(ids), positives), _NONE)
    q, place, value = (found[c].to_numpy(np.int64) for c in ("q", "place", "score"))
    score[q, place - 1] = value
    np.minimum.at(last, q, value)
    least, most = bounds(np.where(score > _NONE, score, 0), low, high)
    windows = spark.sparkContext.broadcast((last, np.where(score > _NONE, least, 1), np.where(score > _NONE, most, 0)))
    candidates.mapInArrow(_packed(block, windows, positives, negatives), "anchor_id long, score long, kind int, id long").write.parquet(path)
    block.destroy()
    windows.destroy()


def streamed(keys: Iterator, positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Negatives by anchor and positive, from sorted keys (anchor, -score, kind, id): kind 0 opens a window, 1 may fall in.

    Gives (anchor, positive, rank from 1, negative, positive's score, negative's score).
    """
    anchor, opened, windows = None, 0, []
    for (at, minus, kind, found), _ in keys:
        if at != anchor:
            anchor, opened, windows = at, 0, []
        score = -minus
        if kind == 0:
            if opened < positives:
                opened += 1
                least, most = bounds(score, low, high)
                windows.append([found, score, least, most, 0])
        elif windows:
            windows = [w for w in windows if w[2] <= score and w[4] < negatives]
            for w in windows:
                if score <= w[3]:
                    w[4] += 1
                    yield anchor, w[0], w[4], found, w[1], score


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Of each anchor and each of its first `positives` rows of its label, the first `negatives` rows of another label whose
    score is at least `low` and at most `high` per cent of the positive's.

    A score is the inner product of floor(scale * x); higher scores come first, ties go to the smaller id. Returns
    anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score; fewer rows where there are fewer.
    Rows with a null id, label or vector, an empty vector, or null or non-finite components take no part. An anchor meets
    vectors of its own length, and none of its own id. Rows that repeat count as often as they are there; of anchors that
    repeat an id the one with the least vector, then label, is asked. Scores of 2^52 or more raise. Empty tables give no
    rows. Other columns are ignored. A task holds at most positives * (negatives + 1) rows by anchor of a block.
    """
    spark = ready(rows.sparkSession)
    label = F.col(label_col).cast("long").alias("label")
    candidates = written(quantised(rows, id_col, vector_col, scale, label).where("label IS NOT NULL").withColumn("size", F.size("v")))
    one = quantised(anchors, id_col, vector_col, scale, label).where("label IS NOT NULL").groupBy("id").agg(F.min(F.struct("v", "label")).alias("a"))
    asked = written(one.select("id", "a.v", "a.label").withColumn("size", F.size("v")))
    sizes = {r["size"]: r["count"] for r in asked.groupBy("size").count().collect()}
    base, schema = scratch(spark), "anchor_id long, score long, kind int, id long"
    spark.createDataFrame([], schema).write.parquet(f"{base}/block=0")
    at = 0
    for size, count in sorted(sizes.items()):
        n = -(-2 * count // ANCHORS_PER_BLOCK)
        for b in range(n):
            own = F.col("size") == size
            block = asked.where(own & (F.pmod(F.xxhash64("id"), F.lit(n)) == b)).select("id", "label", "v").toArrow()
            for first in range(0, block.num_rows, ANCHORS_PER_BLOCK):
                part, at = block.slice(first, ANCHORS_PER_BLOCK).combine_chunks(), at + 1
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                _asked(candidates.where(own).select("id", "label", "v"), ids, labels, _matrix(part.column("v").combine_chunks()), positives, negatives, low, high, f"{base}/block={at}")
    removed(candidates, asked)
    pairs = spark.read.schema(schema).parquet(base).select("anchor_id", "score", "kind", "id").rdd.map(lambda r: ((r[0], -r[1], r[2], r[3]), None))
    # hash() of a pair, as ids of anchors may share a factor with the number of partitions.
    sorted_ = pairs.repartitionAndSortWithinPartitions(partitions(spark), lambda key: hash((key[0], 0)))
    found = sorted_.mapPartitions(lambda keys: streamed(keys, positives, negatives, low, high), preservesPartitioning=True)
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)
