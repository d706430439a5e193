import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators.interval import cut
from spanloom.streaming import streams as T

S = 1_000_000


def test_ingest_drops_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10 * S, "a"), (1, 10 * S, "a"), (1, 20 * S, "a")], "device long, us long, app string").withColumn("at", F.timestamp_micros("us"))
    rows.write.parquet(str(tmp_path / "in"))
    T.run_once(T.ingest(T.source(spark, str(tmp_path / "in"), rows.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_tumbling_equals_batch(spark, tmp_path):
    rows = [(1, "active", i * 400 * S, (i * 400 + 350) * S) for i in range(20)] + [(1, "idle", 10**6 * S, 10**6 * S + 5 * S)]
    df = spark.createDataFrame(rows, "device long, state string, start_us long, end_us long")
    df.write.parquet(str(tmp_path / "in"))
    out = T.tumbling(T.source(spark, str(tmp_path / "in"), df.schema))
    out.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {(r.device, r.state, r.slot * 300 * S): r.us for r in cut(df, 300 * S).groupBy("device", "state", "slot").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us")).collect()}
    assert {(r.device, r.state, r.start_us): r.us for r in spark.table("bins").collect()} == want


def arrivals(spark, folder, rows, schema, at, delay_us, files, seed):
    """rows in files, each no later than delay_us after a row that it precedes; a last file lets the watermark pass all."""
    r = random.Random(seed)
    order = sorted(rows, key=lambda x: x[at] + r.randint(0, delay_us))
    step = -(-len(order) // files)
    for i in range(0, len(order), step):
        spark.createDataFrame(order[i : i + step], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are taken by the time of their last change
    last = [None] * len(rows[0])
    last[0], last[at] = "end", 10**15
    spark.createDataFrame([tuple(last)], schema).coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, tmp_path, name, op, rows, schema, at=2, delay_us=60 * S, files=6, seed=1):
    folder = str(tmp_path / f"{name}in")
    arrivals(spark, folder, rows, schema, at, delay_us, files, seed)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    T.run_once(op(src), str(tmp_path / name), str(tmp_path / f"{name}cp"))
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect())


def folded(rows, step):
    """step over a key's rows in time order, as a batch would."""
    out, state = [], {}
    for r in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        state[r[0]], found = step(state.get(r[0]), r)
        out += [(r[0], *x) for x in found]
    return sorted(out)


EVENTS = "k string, id long, at_us long, identity string, digest long, level double, context string"


def events(seed):
    r = random.Random(seed)
    return [(r.choice("pq"), i, r.randint(1, 1500) * S, r.choice("ab"), r.choice([None, 0, 1]), r.choice([None, 0.1, 0.5, 0.9]), r.choice(["c", "c", "c", None])) for i in range(120)]


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_that_arrive_out_of_order_give_what_a_batch_gives(spark, tmp_path, seed):
    rows = events(seed)

    def kept(state, r):
        at, dropped = state or (None, 0)
        return ((at, dropped + 1), []) if at is not None and r[2] - at < 30 * S else ((r[2], 0), [(r[1], r[2], dropped)])

    assert streamed(spark, tmp_path, "coalesce", lambda s: T.coalesce(s, ["k"], 30 * S, "1 minute"), rows, EVENTS, seed=seed) == folded(rows, kept)

    def tab(state, r):
        return (state, []) if state and state[0] == r[3] and r[2] - state[1] < 30 * S else ((r[3], r[2]), [(r[1], r[2])])

    assert streamed(spark, tmp_path, "tabs", lambda s: T.tab_dedupe(s, ["k"], 30 * S, "1 minute"), rows, EVENTS, seed=seed) == folded(rows, tab)

    def cadence(state, r):
        _, i, at, _, digest, level, context = r
        if state and context is not None and context == state[1]:
            same = digest is not None and digest == state[2] or level is not None and state[3] is not None and abs(level - state[3]) < 0.35
            if at - state[0] < 20 * S or at - state[0] < 120 * S and same:
                return state, []
        return (at, context, digest, level), [(i, at)]

    assert streamed(spark, tmp_path, "cadence", lambda s: T.frame_cadence(s, ["k"], change=0.35, delay="1 minute"), rows, EVENTS, seed=seed) == folded(rows, cadence)


def test_a_row_that_waited_for_its_place(spark, tmp_path):
    """Times 0, 150 and then 120, 230 with a span of 100 keep 0, 120 and 230, in one batch or two."""
    rows = [("p", i, (1000 + t) * S) for i, t in enumerate((0, 150, 120, 230))]
    for part in (1, 2):
        folder = str(tmp_path / f"in{part}")
        for at in range(0, 4, 4 // part):
            spark.createDataFrame(rows[at : at + 4 // part], "k string, id long, at_us long").coalesce(1).write.mode("append").parquet(folder)
            time.sleep(0.02)
        spark.createDataFrame([("end", None, 10**15)], "k string, id long, at_us long").write.mode("append").parquet(folder)
        src = spark.readStream.schema("k string, id long, at_us long").option("maxFilesPerTrigger", 1).parquet(folder)
        T.run_once(T.coalesce(src, ["k"], 100 * S, "1 minute"), str(tmp_path / f"out{part}"), str(tmp_path / f"cp{part}"))
        assert sorted((r.at_us // S, r.dropped) for r in spark.read.parquet(str(tmp_path / f"out{part}")).collect()) == [(1000, 0), (1120, 0), (1230, 1)]


def test_context_sessions_end_by_context_and_by_silence(spark, tmp_path):
    r = random.Random(4)
    rows, at = [], S
    for _ in range(150):
        at += r.choice([0, 0, 1, 5]) * S
        rows.append((r.choice("pq"), at, at + 10 * S, r.choice(["c", "c", "d", None]), r.randint(1, 9)))
        at += 10 * S
    schema = "k string, start_us long, end_us long, context string, us long"
    want, open_ = [], {}
    for k, s, e, c, u in sorted(rows, key=lambda x: (x[1], x[2])):
        now = open_.get(k)
        if now and now[1] == c and 0 <= s - now[3] <= S:
            now[3], now[4], now[5] = max(now[3], e), now[4] + u, now[5] + 1
            continue
        if now:
            want.append(tuple(now))
        open_[k] = [k, c, s, e, u, 1] if c else None
    want += [tuple(x) for x in open_.values() if x]
    got = streamed(spark, tmp_path, "sessions", lambda s: T.context_sessions(s, ["k"], S, "1 minute"), rows, schema, at=1)
    assert got == sorted(want) and len(got) < len([x for x in rows if x[3]])


def test_freshness_changes_come_from_timers(spark, tmp_path):
    rows = events(9)
    want = []
    for k in "pq":
        at = sorted({x[2] for x in rows if x[0] == k})
        want += [(k, t, "fresh") for i, t in enumerate(at) if not i or t - at[i - 1] > 25 * S]
        want += [(k, t + 25 * S, "stale") for i, t in enumerate(at) if i + 1 == len(at) or at[i + 1] - t > 25 * S]
    assert streamed(spark, tmp_path, "fresh", lambda s: T.freshness_changes(s, ["k"], 25 * S, "1 minute"), rows, EVENTS) == sorted(want)


def test_lateness(spark):
    h = 3600 * S
    df = spark.createDataFrame([(0, 0), (0, 6 * h), (0, 6 * h + 1), (30 * h, 66 * h + 1)], "at long, got long")
    assert [(r.day, r.kind) for r in T.lateness(df, "at", "got").orderBy("at", "got").collect()] == [(0, "current"), (0, "current"), (0, "late"), (1, "backfill")]
