"""Chains by pointer doubling, and the folds on them, against loops over sorted rows."""

import random

import pytest

from spanloom.operators import chain, fold

S = 1_000_000
DAY = 86_400 * S
SCHEMA = "device long, id long, at_us long, app string, vector array<double>, eligible boolean, context string, digest long, level double, n long"


def walk(steps):
    met, n = [], 1
    while n <= len(steps):
        met.append(n)
        n = steps[n - 1]
    return met


@pytest.mark.parametrize("lot, reach", [(4, 3), (4, 30), (16, 5), (chain.LOT, 9)])
def test_followed_equals_a_walk(spark, monkeypatch, lot, reach):
    """Lots far smaller than a key, steps that leap over lots, a null key, and a key of one row."""
    monkeypatch.setattr(chain, "LOT", lot)
    r = random.Random(lot * reach)
    of = {k: [n + r.randint(1, reach) for n in range(1, size + 1)] for k, size in ((1, 300), (None, 97), (3, 1), (4, lot if lot < 100 else 64))}
    rows = [(k, n + 1, x, f"v{n + 1}") for k, steps in of.items() for n, x in enumerate(steps)]
    r.shuffle(rows)
    got = chain.followed(spark.createDataFrame(rows, "k long, n long, next long, v string").repartition(3), ["k"], ["v"]).collect()
    assert sorted((str(x.k), x.n) for x in got) == sorted((str(k), n) for k, steps in of.items() for n in walk(steps))
    assert all(x.v == f"v{x.n}" and x.next == of[x.k][x.n - 1] for x in got)


def test_rounds_grow_with_the_logarithm_of_lots(spark, monkeypatch):
    """A chain of single steps through 256 lots: written are lots, 9 tables of jumps, one of starts and one a round."""
    monkeypatch.setattr(chain, "LOT", 4)
    plain, made = chain.written, []
    monkeypatch.setattr(chain, "written", lambda df: made.append(1) or plain(df))
    steps = spark.range(1, 1025).selectExpr("1L AS k", "id AS n", "id + 1 AS next")
    assert chain.followed(steps, ["k"], []).count() == 1024
    assert len(made) <= 1 + 9 + 1 + 8


def test_no_rows(spark):
    none = spark.createDataFrame([], "k long, n long, next long")
    assert chain.followed(none, ["k"], []).collect() == []
    f = spark.createDataFrame([], SCHEMA)
    for df in (fold.feature_dedupe(f, ["device"]), fold.similarity_clusters(f, ["device"]), fold.cadence_keep(f, ["device"])):
        assert df.collect() == []


def near(a, b, d):
    return a is not None and b is not None and len(a) == len(b) and None not in a + b and sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 <= d


def loops(rows, span, d, least, most, change):
    """Kept ids, (id, first_id) of clusters, and ids kept by cadence, of one device's rows in order."""
    kept, clusters, cadence, last, first, app, rec = [], [], [], None, None, None, None
    for x in rows:
        _, i, at, a, v, ok, c, g, level = x[:9]
        if last is None or not (at - last[2] <= span and near(v, last[4], d)):
            last = x
            kept.append(i)
        if not ok or v is None:
            first = None
        else:
            if first is None or a != app or at - first[2] > span or not near(v, first[4], d):
                first = x
            app = a
            clusters.append((i, first[1]))
        drop = False
        if rec is not None and rec[6] == c:
            age = at - rec[2]
            small = level is not None and rec[8] is not None and abs(level - rec[8]) < change
            drop = age < least or age < most and (g is not None and g == rec[7] or small)
        if not drop:
            rec = x
            cadence.append(i)
    return kept, clusters, cadence


@pytest.mark.parametrize("lot", [8, chain.LOT])
def test_folds_equal_loops(spark, monkeypatch, lot):
    """A device without a hole over midnight, sparse ones, ties in time, and nulls in every column but the id."""
    monkeypatch.setattr(chain, "LOT", lot)
    r = random.Random(lot)
    some = lambda x: None if r.random() < 0.08 else x
    rows = []
    for device, count, step in ((1, 700, 10 * S), (None, 150, 45 * S), (3, 40, DAY // 3)):
        at = DAY - 3000 * S
        for i in range(count):
            at += r.choice([0, step, step, step // 2])
            v = some([some(r.random() * 0.2) if r.random() < 0.05 else r.random() * 0.2, 0.1])
            if r.random() < 0.03:
                v = [0.1]
            rows.append((device, len(rows), at, some(r.choice("aab")), v, some(r.random() < 0.9), some(r.choice("cccd")), some(r.randrange(3)), some(r.random() * 3), 7))
    order = rows[:]
    r.shuffle(rows)
    f = spark.createDataFrame([*rows, (1, 10**6, None, "a", [0.1, 0.1], True, "c", 1, 1.0, 7)], SCHEMA).repartition(4)
    got = [fold.feature_dedupe(f, ["device"], distance=0.08), fold.similarity_clusters(f, ["device"], distance=0.08), fold.cadence_keep(f, ["device"])]
    for df in got:
        assert "MapInArrow" not in df._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    kept, clusters, cadence = [df.collect() for df in got]
    for device in (1, None, 3):
        a, b, c = loops([x for x in order if x[0] == device], 120 * S, 0.08, 20 * S, 120 * S, 1.0)
        assert sorted(x.id for x in kept if x.device == device) == a
        assert sorted((x.id, x.first_id) for x in clusters if x.device == device) == b
        assert sorted(x.id for x in cadence if x.device == device) == c
