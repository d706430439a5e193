"""Connected components and joins on hot keys, against a plain union-find and a plain join."""

import random

from pyspark.sql import functions as F

from spanloom.operators import components as C


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up if find(x) != x}


def got(spark, edges):
    return {r.u: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    assert got(spark, chain) == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_random_and_hub(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_HOT", 5)
    r = random.Random(4)
    for n in (30, 200):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(n)] + [(n + 5, i) for i in range(0, n, 3)]
        assert got(spark, edges) == roots(edges)


def test_long_chain_settles(spark):
    ids = random.Random(5).sample(range(10_000), 400)
    chain = list(zip(ids, ids[1:]))
    assert got(spark, chain) == roots(chain)


def test_stars_need_no_round(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(C, "written", lambda df, f=C.written: writes.append(1) or f(df))
    star = [(0, i) for i in range(1, 30)] + [(100, 101), (100, 101), (103, 100)]
    assert got(spark, star) == roots(star) and len(writes) == 1
    assert got(spark, [*star, (29, 100)]) == roots([*star, (29, 100)]) and len(writes) > 2


def test_meet(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_HOT", 3)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 2), (3, 4), (9, 1)) for i in range(n)], "k long, i long")
    stats = spark.createDataFrame([(1, 50, "a"), (2, 2, None), (3, 4, "c")], "k long, n long, x string")
    met = C.meet(rows, stats, "k", "n", 57)
    assert met.columns == ["k", "i", "n", "x"] and met.count() == 56
    assert {(r.k, r.x) for r in met.select("k", "x").distinct().collect()} == {(1, "a"), (2, None), (3, "c")}
    assert met.where(F.col("k") == 9).count() == 0
