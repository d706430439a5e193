"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate. Each round splits the score range in which a query's kth score lies
into bins, counts scores by bin over the whole cluster, and keeps the bin that holds the kth score. When the range is
one score wide, rows at or above it are kept, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import ready, removed, scratch, written

BINS = 256
QUERIES_PER_BLOCK = 4096
#: Candidates that a task scores at once: the score matrix of a block has this many rows.
CHUNK = 1024
LEAST, MOST = -(2**62), 2**62


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int, *more: Column) -> DataFrame:
    """(id, v): floor(scale * x) for each component; vectors that are null, empty or hold null or non-finite ones go."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"), *more
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, queries by candidates; by floats where these are exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound >= 2**62:
        raise ValueError("scores of 2^62 or more")
    return q @ c.T


def _scored(block, batches):
    """For each batch of candidates: ids, and scores of all queries with a query's own row set apart."""
    ids, q = block
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            c = _matrix(part.column("v"))
            cid = part.column("id").to_numpy()
            s = _scores(q, c)
            yield cid, s, ids[:, None] == cid[None, :]


def _counts(block, low: np.ndarray, width: np.ndarray, k: int):
    """Counts of scores by bin. A task tells no bin below the one with its own kth score: the global kth lies no lower."""

    def run(batches):
        n = len(low)
        total = np.zeros((n, BINS + 1), np.int64)
        for _, s, own in _scored(block.value, batches):
            at = (s - low[:, None]) // width[:, None]
            ok = (at >= 0) & ~own
            at = np.minimum(at, BINS)
            flat = (np.arange(n)[:, None] * (BINS + 1) + at)[ok]
            total += np.bincount(flat, minlength=n * (BINS + 1)).reshape(n, BINS + 1)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
        q, b = np.nonzero((total > 0) & (above - total < k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(total[q, b], pa.int64())], ["q", "b", "n"])

    return run


def _range():
    """The lowest and highest score by query, from one pass."""

    def make(block):
        def run(batches):
            n = len(block.value[0])
            low, high, rows = np.full(n, MOST), np.full(n, LEAST), np.zeros(n, np.int64)
            for _, s, own in _scored(block.value, batches):
                low = np.minimum(low, np.where(own, MOST, s).min(axis=1))
                high = np.maximum(high, np.where(own, LEAST, s).max(axis=1))
                rows += (~own).sum(axis=1)
            q = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(low[q]), pa.array(high[q]), pa.array(rows[q])], ["q", "low", "high", "n"])

        return run

    return make


def _kept(block, least: np.ndarray, k: int):
    """Rows at or above the kth score. Of rows with that very score a task sends k at most, those of smallest ids."""

    def run(batches):
        ids = block.value[0]
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        fresh: dict[int, int] = {}
        for cid, s, own in _scored(block.value, batches):
            hit = (s >= least[:, None]) & ~own
            for q in np.flatnonzero(hit.any(axis=1)):
                c, v = np.concatenate([held[q][0], cid[hit[q]]]), np.concatenate([held[q][1], s[q][hit[q]]])
                order = np.lexsort((c, -v))[:k]
                held[q] = (c[order], v[order])
                fresh[int(q)] = 1
        qs = [np.full(len(held[q][0]), ids[q]) for q in sorted(fresh)]
        if qs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(qs)), pa.array(np.concatenate([held[q][0] for q in sorted(fresh)])), pa.array(np.concatenate([held[q][1] for q in sorted(fresh)]))],
                ["query_id", "vec_id", "score"],
            )

    return run


_ROWS = "query_id long, vec_id long, score long"


def _block(spark, candidates: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, path: str) -> None:
    """Writes the rows of one block of queries: counting rounds, then the filter."""
    n = len(ids)
    block = spark.sparkContext.broadcast((ids, q))  # at most QUERIES_PER_BLOCK vectors
    bounds = candidates.mapInArrow(_range()(block), "q int, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    low, high, rows = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in bounds:
        low[r.q], high[r.q], rows[r.q] = r.low, r.high, r.n
    # A query with k candidates or fewer keeps all of them.
    low[rows <= k], high[rows <= k] = LEAST, LEAST
    high = high + 1
    while ((high - low) > 1).any():
        width = np.maximum(1, -(-(high - low) // BINS))
        found = candidates.mapInArrow(_counts(block, low, width, k), "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros((n, BINS + 1), np.int64)
        table[found.q.to_numpy(np.int64), found.b.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
        above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]  # scores in this bin and higher
        at = BINS - np.argmax((above >= k)[:, ::-1], axis=1)
        open_ = (high - low) > 1
        new = low + at * width
        high = np.where(open_, np.minimum(new + width, high), high)
        low = np.where(open_, new, low)
    candidates.mapInArrow(_kept(block, low, k), _ROWS).write.parquet(path)
    block.destroy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k rows of `vectors` with the highest inner product for each row of `queries`, without the query's own id.

    Returns (query_id, rank from 1, vec_id, score); fewer than k rows where there are fewer candidates. Rows with a
    null id, a null or empty vector, or null or non-finite components take no part. A query meets the vectors of its own
    length. Ties go to the smaller id; rows that repeat an id count as often as they are there. Empty tables give no rows.
    Queries are taken in blocks of about QUERIES_PER_BLOCK / 2; a block's rows are written and its broadcast destroyed before
    the next one begins, so what the driver holds and the last plan do not grow with the number of blocks; each block's
    scoring has all tasks. Of queries that repeat an id the one with the least vector is asked. Scores of 2^62 or more
    raise. Other columns are ignored.
    """
    spark = ready(vectors.sparkSession)
    candidates = quantised(vectors, id_col, vector_col, scale).withColumn("size", F.size("v"))
    asked = quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    sizes = {r["size"]: r["count"] for r in asked.groupBy("size").count().collect()}
    blocks = [(size, b, n) for size, count in sorted(sizes.items()) for n in [-(-count // (QUERIES_PER_BLOCK // 2))] for b in range(n)]
    if len(blocks) > 1:  # each block reads both again
        candidates = written(candidates)
        asked = written(asked)
    base = scratch(spark)
    spark.createDataFrame([], _ROWS).write.parquet(f"{base}/block=0")
    for at, (size, b, n) in enumerate(blocks, 1):
        own = F.col("size") == size
        rows = asked.where(own & (F.pmod(F.xxhash64("id"), F.lit(n)) == b)).select("id", "v").toArrow()
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks().sort_by("id")
        _block(spark, candidates.where(own).select("id", "v"), rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks()), k, f"{base}/block={at}")
    if len(blocks) > 1:
        removed(candidates, asked)
    out = spark.read.schema(_ROWS).parquet(base)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
