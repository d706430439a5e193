"""Helpers that the training-data operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from spanloom.sources.scratch import removed, scratch, written
from spanloom.sources.workers import importable

ROWS_PER_BATCH = 512


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small.

    A batch of documents holds whole texts; 512 rows bound what a worker has at once.
    """
    importable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def in_one_task(rows: DataFrame, make: Callable[[pa.Table], object]):
    """make(all rows), run in one task; its pickled result comes back. For samples of a fixed bound: a model's fit.

    `make` gets the columns of rows in any order of rows; None where it returns None.
    """
    names = rows.columns

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            made = pickle.dumps(make(pa.Table.from_batches(got).select(names)))
            got.clear()
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["made"])

    made = rows.repartition(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(made[0].made) if made else None


def added(docs: DataFrame, kept: list[str], given: Column, new: list[tuple[str, DataType | str]], run: Callable) -> DataFrame:
    """The columns `kept` of docs, whatever their names, and new ones.

    run(batches) gets these columns and then `given`, as column "__text", and yields the arrays of a batch: those of the kept
    columns and those of the new ones.
    """
    names = [f"c{i}" for i in range(len(kept) + len(new))]
    told = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=False)], given.alias("__text"))
    schema = told.select(*names[: len(kept)]).schema
    for n, (_, kind) in zip(names[len(kept) :], new, strict=True):
        schema = schema.add(n, kind)

    def each(batches):
        for arrays in run(batches):
            yield pa.RecordBatch.from_arrays(arrays, names)

    return told.mapInArrow(each, schema).toDF(*kept, *[n for n, _ in new])


def give_back() -> None:
    """Return memory that this worker has freed: workers go on from task to task, and what one left adds to the next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def empty_text(column: str = "text"):
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch whose texts have about `most` bytes; a longer text is a part of its own."""
    ends = offsets(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array without nulls, from 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind, count=column.offset + len(column) + 1)[column.offset :]
    return raw.astype(np.int64) - int(raw[0])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array without nulls, and the offsets of its texts in them."""
    ends = offsets(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    size = 8 if wide else 4
    first = int.from_bytes(memoryview(column.buffers()[1])[column.offset * size : (column.offset + 1) * size], "little")
    data = column.buffers()[2]
    if data is None or not ends[-1]:
        return np.zeros(0, np.uint8), ends
    return np.frombuffer(data, dtype=np.uint8, count=first + int(ends[-1]))[first:], ends


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by keys.

    Small groups come many at a time, about `least` rows; the last group of what has arrived waits for its rest.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(rows, dtype=bool)
        for k in keys:
            values = whole.column(k).to_numpy()
            same &= values == values[-1]
        cut = int(rows - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(table_: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of a sorted table begins, and the end."""
    new = np.zeros(table_.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        values = table_.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), table_.num_rows)


#: Bits of a key filter: a table of FILTER_BITS / 32768 rows of 4 KB, 8 MB whatever the number of keys.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of the hashes of a column's values, for passing(): of bounded size, so it may be broadcast."""
    h = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    return keys.select(h.alias("h")).groupBy(F.shiftright("h", 15).cast("int").alias("__row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))


def passing(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows of df whose value may be among the keys: all that are, and few others unless the filter is full.

    It only spares a join rows that would find no partner; the join itself decides.
    """
    h = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    told = df.withColumns({"__row": F.shiftright(h, 15).cast("int"), "__at": F.bitmap_bit_position(h).cast("int")}).join(F.broadcast(bits), "__row")
    byte = F.conv(F.hex(F.substr("__bits", F.shiftright("__at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return told.where(F.getbit(byte, F.col("__at").bitwiseAND(7)) == 1).drop("__row", "__at", "__bits")


def first_by_hash(df: DataFrame, column: str, most: int, total: int) -> DataFrame:
    """The first `most` rows by a hash of a column, a sample that is the same each time.

    A bound on the hash, wide enough for three times as many rows, comes first, so no task gets all of them.
    """
    h = F.xxhash64(column)
    if total > 3 * most:
        df = df.where(F.pmod(F.xxhash64(column, F.lit(1)), F.lit(1 << 32)) < int((1 << 32) * 3 * most / total))
    return df.orderBy(h, column).limit(most)


__all__ = [
    "added", "empty_text", "first_by_hash", "give_back", "groups", "in_one_task", "key_filter", "offsets", "partitions", "passing", "ready",
    "removed", "scratch", "slices", "starts", "table", "utf8", "written",
]
