"""Structured Streaming forms: each gives what its batch form gives once all input is there."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from spanloom.functions.time import SECOND
from spanloom.sources.scratch import removed, written
from spanloom.sources.workers import importable

#: How late rows may come: they wait so long for those before them; later ones are dropped.
DELAY = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema: StructType | str, most_bytes: int = 1 << 30) -> DataFrame:
    """The files of a folder as a stream, most_bytes of them in one batch, so that a backlog is many batches."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(most_bytes)).parquet(path)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet") -> None:
    """Takes all input that is there, then stops; a restart goes on from the checkpoint."""
    df.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def ingest(samples: DataFrame, at: str = "at", delay: str = "6 hours") -> DataFrame:
    """Samples once by their content id, however often and in whatever order they arrive within the delay."""
    cols = [F.col(c).cast("string") for c in sorted(samples.columns)]
    told = samples.withColumn("row_id", F.sha2(F.concat_ws("|", *cols), 256))
    return told.withWatermark(at, delay).dropDuplicatesWithinWatermark(["row_id"])


def tumbling(runs: DataFrame, minutes: int = 5, delay: str = "1 hour") -> DataFrame:
    """Time by device, state and slot. Runs (device, state, start_us, end_us) are cut at slot edges before windowing."""
    step = minutes * 60 * SECOND
    slots = F.sequence(F.floor(F.col("start_us") / step), F.floor((F.col("end_us") - 1) / step))
    cut = runs.withColumn("slot", F.explode(slots))
    cut = cut.withColumn("us", F.least("end_us", (F.col("slot") + 1) * step) - F.greatest("start_us", F.col("slot") * step)).withColumn("at", F.timestamp_micros(F.col("slot") * step))
    summed = cut.withWatermark("at", delay).groupBy(F.window("at", f"{minutes} minutes"), "device", "state").agg(F.sum("us").alias("us"))
    return summed.select("device", "state", F.unix_micros("window.start").alias("start_us"), "us")


def sessions(events: DataFrame, gap: str, delay: str = "1 hour", at: str = "at") -> DataFrame:
    """Sessions by device: events whose gaps stay below `gap`."""
    grouped = events.withWatermark(at, delay).groupBy(F.session_window(at, gap), "device").agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("device", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "events")


class Ordered(StatefulProcessor):
    """One pass over a key's rows in time order, however they arrive within the watermark's delay.

    Rows wait in a list state until the watermark has passed them, then are taken in order; a row that comes after the
    watermark under which its key's rows were last taken is late and dropped. Between batches there is that
    list, whose length the delay bounds, that watermark, and a state of one row. Times are after 1970, where watermarks begin. step(state, row) gives the next state and a list of output
    rows; state is None at first. due(state) may name a moment at which, unless a row comes first, end(state) is asked for
    the next state and output; an event-time timer wakes the key for it.
    """

    def __init__(self, state: str, row: list[tuple[str, str]], order: list[str], columns: list[str], step, due=None, end=None):
        self.state, self.row, self.order, self.columns, self.step, self.due, self.end = state, row, order, columns, step, due, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)
        self.passed = handle.getValueState("passed", "us LONG")
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in self.row))

    def _tuples(self, pdf: pd.DataFrame) -> list[tuple]:
        cols = []
        for name, kind in self.row:
            whole = kind == "bigint"
            cols.append([None if pd.isna(v) else int(v) if whole else v for v in pdf[name].tolist()])
        return list(zip(*cols, strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, low = [n for n, _ in self.row].index(self.order[0]), None
        passed = self.passed.get()[0] if self.passed.exists() else None
        for pdf in rows:
            told = [r for r in self._tuples(pdf) if r[at] is not None and (passed is None or r[at] > passed)]
            if told:
                self.waiting.appendList(told)
                first = min(r[at] for r in told)
                low = first if low is None else min(low, first)
        if low is not None:
            self._wake(low)
        yield pd.DataFrame([], columns=self.columns)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(max(us // 1000 + 1, 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.passed.update((passed,))
        names = [n for n, _ in self.row]
        kind, at = namedtuple("Row", names), names.index(self.order[0])
        places = [names.index(n) for n in self.order]
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: [r[p] for p in places]) if self.waiting.exists() else []
        state, out = (tuple(self.last.get()) if self.last.exists() else None), []
        ready = [r for r in waiting if r[at] <= passed]
        for r in ready:
            state = self._closed(state, r[at], out)
            state, found = self.step(state, kind(*r))
            out += found
        state = self._closed(state, passed + 1, out)
        if ready:
            if len(ready) < len(waiting):
                self.waiting.put(waiting[len(ready) :])
            else:
                self.waiting.clear()
        if state is None:
            self.last.clear()
        else:
            self.last.update(state)
            if self.due is not None and self.due(state) is not None:
                self._wake(self.due(state))
        if len(ready) < len(waiting):
            self._wake(waiting[len(ready)][at])
        yield pd.DataFrame([(*key, *x) for x in out], columns=self.columns)

    def _closed(self, state, before: int, out: list):
        """The state once everything due before a moment has ended."""
        while state is not None and self.due is not None and self.due(state) is not None and self.due(state) < before:
            state, found = self.end(state)
            out += found
        return state

    def close(self) -> None:
        pass


def _ordered(rows: DataFrame, keys: list[str], order: list[str], state: str, out: str, step, delay: str, due=None, end=None) -> DataFrame:
    spark = importable(rows.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = [*keys, *[x.split()[0] for x in out.split(", ")]]
    schema = rows.select(*keys).schema
    for x in out.split(", "):
        schema = schema.add(*x.split())
    row = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name not in keys]
    # The time of the watermark stays out of what goes to Python, where pandas has no moments beyond 2262.
    timed = rows.withColumn("__at", F.timestamp_micros(order[0])).withWatermark("__at", delay).drop("__at")
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=Ordered(state, row, order, columns, step, due, end), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def coalesce(events: DataFrame, keys: list[str], span_us: int, delay: str = DELAY) -> DataFrame:
    """Events (keys, at_us, id) that no kept one of the same keys precedes by less than span_us, each with how many were
    dropped since the kept one before."""

    def step(state, row):
        at, dropped = state or (None, 0)
        if at is not None and row.at_us - at < span_us:
            return (at, dropped + 1), []
        return (row.at_us, 0), [(row.id, row.at_us, dropped)]

    return _ordered(events.select(*keys, "id", "at_us"), keys, ["at_us", "id"], "at LONG, dropped LONG", "id long, at_us long, dropped long", step, delay)


def tab_dedupe(events: DataFrame, keys: list[str], span_us: int = 3 * SECOND, delay: str = DELAY) -> DataFrame:
    """Tab events (keys, id, at_us, identity) without those that repeat the last one sent within span_us."""

    def step(state, row):
        if state is not None and state[0] == row.identity and row.at_us - state[1] < span_us:
            return state, []
        return (row.identity, row.at_us), [(row.id, row.at_us)]

    return _ordered(events.select(*keys, "id", "at_us", "identity"), keys, ["at_us", "id"], "identity STRING, at LONG", "id long, at_us long", step, delay)


def frame_cadence(frames: DataFrame, keys: list[str], least_us: int = 20 * SECOND, most_us: int = 120 * SECOND, change: float = 1.0, delay: str = DELAY) -> DataFrame:
    """Frames (keys, id, at_us, context, digest, level) to keep, by the rules of fold.cadence_keep."""

    def step(state, row):
        if state is not None and row.context is not None and row.context == state[1]:
            age = row.at_us - state[0]
            same = row.digest is not None and row.digest == state[2] or row.level is not None and state[3] is not None and abs(row.level - state[3]) < change
            if age < least_us or age < most_us and same:
                return state, []
        return (row.at_us, row.context, row.digest, row.level), [(row.id, row.at_us)]

    return _ordered(frames.select(*keys, "id", "at_us", "context", "digest", "level"), keys, ["at_us", "id"], "at LONG, context STRING, digest LONG, level DOUBLE", "id long, at_us long", step, delay)


def identity_samples(samples: DataFrame, path: str, checkpoint: str, recent: int = 60, delay: str = DELAY, lot: str = "5 minutes") -> None:
    """Leaves at path each sample (device, id, at_us, state) that the watermark has passed, with the windows, and the untitled
    ones, among its device's last `recent`. Takes all input that is there, then stops; a restart goes on.

    Samples wait in lots of time, by device, so no task has a device's history. Lots that a batch closes are counted each on
    its own, after the states of the samples before: one string by lot, w for a titled window, u for an untitled one, - for
    anything else. A device's last ones are kept by batch beside the output, so a batch that is repeated finds them again.
    """
    spark, few = samples.sparkSession, recent - 1
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    code = F.when(F.col("state") == "active", "w").when(F.col("state") == "unattributed", "u").otherwise("-")
    timed = samples.select("device", F.timestamp_micros("at_us").alias("at"), F.struct("at_us", "id", code.alias("code")).alias("s")).withWatermark("at", delay)
    lots = timed.groupBy("device", F.window("at", lot)).agg(F.collect_list("s").alias("rows")).select("device", F.unix_micros("window.start").alias("lot"), F.sort_array("rows").alias("rows"))
    rolling, by_lot = Window.partitionBy("device", "lot").orderBy("place").rowsBetween(-few, 0), Window.partitionBy("device").orderBy("lot")
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: r.code), "")

    def batch(df: DataFrame, n: int) -> None:
        closed = written(df)
        tails = closed.select("device", "lot", joined(F.slice("rows", F.greatest(F.lit(1), F.size("rows") - few + 1), few)).alias("tail"))
        if n:
            tails = tails.unionByName(spark.read.schema(tails.schema).parquet(f"{path}-tails/{n - 1}"))
        # A lot has one sample at least, so the lots before it that matter are as few as the samples.
        before = tails.withColumn("before", F.right(F.array_join(F.collect_list("tail").over(by_lot.rowsBetween(-few, -1)), ""), F.lit(few)))
        before.groupBy("device").agg(F.max("lot").alias("lot"), F.max_by(F.right(F.concat("before", "tail"), F.lit(few)), "lot").alias("tail")).write.mode("overwrite").parquet(f"{path}-tails/{n}")
        led = closed.join(before.select("device", "lot", "before"), ["device", "lot"])
        none = F.transform(F.filter(F.split("before", ""), lambda x: x != ""), lambda x: F.struct(F.lit(None).cast("long").alias("at_us"), F.lit(None).cast("long").alias("id"), x.alias("code"), F.lit(False).alias("own")))
        own = F.transform("rows", lambda r: F.struct(r.at_us.alias("at_us"), r.id.alias("id"), r.code.alias("code"), F.lit(True).alias("own")))
        each = led.select("device", "lot", F.posexplode(F.concat(none, own)).alias("place", "s")).select("device", "lot", "place", "s.*")
        told = each.withColumns({"windows": F.sum((F.col("code") != "-").cast("long")).over(rolling), "untitled": F.sum((F.col("code") == "u").cast("long")).over(rolling)}).where("own")
        told.select("device", "id", "windows", "untitled").write.mode("overwrite").parquet(f"{path}/{n}")
        removed(closed)

    lots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def context_sessions(parts: DataFrame, keys: list[str], gap_us: int = SECOND, delay: str = DELAY) -> DataFrame:
    """Sessions of one context: parts (keys, start_us, end_us, context, us) that follow one another at most gap_us apart.

    A part of another context, or of none, ends a session at once; a longer silence ends it when the watermark has passed
    it. Gives keys, context, start_us, end_us, us, parts.
    """

    def step(state, row):
        gap = None if state is None else row.start_us - state[2]
        if state is not None and row.context == state[0] and 0 <= gap <= gap_us:
            return (state[0], state[1], max(state[2], row.end_us), state[3] + row.us, state[4] + 1), []
        done = [] if state is None else [state]
        return (None if row.context is None else (row.context, row.start_us, row.end_us, row.us, 1)), done

    columns = "context string, start_us long, end_us long, us long, parts long"
    told = parts.select(*keys, "start_us", "end_us", "context", "us")
    return _ordered(told, keys, ["start_us", "end_us"], columns.replace("string", "STRING"), columns, step, delay, due=lambda s: s[2] + gap_us, end=lambda s: (None, [s]))


def freshness_changes(receipts: DataFrame, keys: list[str], limit_us: int, delay: str = DELAY) -> DataFrame:
    """When each source becomes fresh and stale: (keys, at_us, status) out of receipts (keys, at_us).

    A source is fresh from a receipt until limit_us later; a timer tells that it went stale, with no receipt needed.
    """

    def step(state, row):
        return (row.at_us, "fresh"), ([] if state is not None and state[1] == "fresh" else [(row.at_us, "fresh")])

    def end(state):
        return (state[0], "stale"), [(state[0] + limit_us, "stale")]

    return _ordered(receipts.select(*keys, "at_us"), keys, ["at_us"], "at LONG, status STRING", "at_us long, status string", step, delay, due=lambda s: s[0] + limit_us if s[1] == "fresh" else None, end=end)


def last_receipts(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """The latest receipt's time by keys, kept as receipts (keys, at_us) come in; for complete or update mode."""
    return receipts.groupBy(*keys).agg(F.max("at_us").alias("at_us"))


def run_complete(df: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all input that is there and leaves the whole result of an aggregation, as of the last batch, at path."""

    def batch(out: DataFrame, _: int) -> None:
        out.write.mode("overwrite").parquet(path)

    df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def lateness(rows: DataFrame, at: str, received: str) -> DataFrame:
    """rows with their UTC day and kind: current, late (over 6 hours, what a scan's look-back still sees) or backfill (over
    36 hours, what only redoing the day brings in)."""
    late = F.col(received) - F.col(at)
    kind = F.when(late > 36 * 3600 * SECOND, "backfill").when(late > 6 * 3600 * SECOND, "late").otherwise("current")
    return rows.withColumns({"day": F.floor(F.col(at) / (86_400 * SECOND)), "kind": kind})


def mark_touched(rows: DataFrame, path: str, checkpoint: str, cols: list[str]) -> None:
    """Each batch appends the distinct values of cols that it touched: the days to recompute, and why."""

    def batch(df: DataFrame, _: int) -> None:
        df.select(*cols).distinct().write.mode("append").parquet(path)

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
