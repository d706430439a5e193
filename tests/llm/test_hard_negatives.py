"""Mined negatives against brute force, with ties, repeated rows and odd rows."""

import math
import random

import pytest

from spanloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, size string, score double"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256):
    fit = lambda r: r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])
    ok = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if fit((i, v, lab))]
    own = {}
    for i, v, lab in sorted(((i, [math.floor(scale * x) for x in v], lab) for i, v, lab in anchors if fit((i, v, lab)))):
        own.setdefault(i, (v, lab))
    out = []
    for a, (v, lab) in own.items():
        s = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m == lab) for i, w, m in ok if i != a and len(w) == len(v))
        for minus, p, _ in [x for x in s if x[2]][:positives]:
            found = [(i, -t) for t, i, same in s if not same and low * -minus <= 100 * -t <= high * -minus][:negatives]
            out += [(a, p, r, i, -minus, t) for r, (i, t) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "i", 1, "s", 0.5) for i, v, lab in rows], SCHEMA)


@pytest.mark.parametrize("seed,dim,chunk,block", [(1, 4, 1024, 4096), (2, 3, 7, 2), (3, 2, 16, 3)])
def test_brute_force(spark, monkeypatch, seed, dim, chunk, block):
    monkeypatch.setattr(H, "CHUNK", chunk)
    monkeypatch.setattr(H, "ANCHORS_PER_BLOCK", block)
    r = random.Random(seed)
    rows = [(r.randint(0, 400), [r.randint(-3, 3) / 4 for _ in range(dim if r.random() < 0.9 else dim + 1)], r.randint(0, 2)) for _ in range(220)]
    rows += rows[:30] + [(9, [0.0] * dim, 1), (20, [0.0] * dim, 1), (30, [1.0] * dim, 1)]
    rows += [(None, [1.0] * dim, 1), (1, None, 1), (2, [], 1), (3, [None] * dim, 1), (4, [float("nan")] * dim, 1), (5, [float("inf")] * dim, 0), (10, [1.0] * dim, None)]
    anchors = [x for x in rows if x[0] is not None and x[0] % 10 == 0]
    df = frame(spark, rows).repartition(3)
    got = H.mine(df, df.where("vec_id % 10 = 0"))
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_windows_of_zero_and_below(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 2.0], 2), (4, [0.0, -2.0], 2), (5, [-0.5, 0.0], 2)]
    df = frame(spark, rows)
    got = sorted(tuple(x) for x in H.mine(df, df.where("vec_id = 0")).collect())
    assert got == brute(rows, rows[:1]) == [(0, 1, 1, 3, 0, 0), (0, 1, 2, 4, 0, 0)]


def test_stream_holds_windows_only():
    keys = (((a, -s, k, i), None) for a in (1, 2) for s, k, i in [(100, 0, 5), (95, 1, 8), (90, 1, 9), (30, 1, 7), (29, 1, 6)])
    assert list(H.streamed(keys, 1, 10, 30, 90)) == [(a, 5, r, i, 100, s) for a in (1, 2) for r, i, s in [(1, 9, 90), (2, 7, 30)]]


def test_empty_and_alone(spark):
    none = frame(spark, [(0, [1.0], 1)]).limit(0)
    assert H.mine(none, none).count() == 0
    one = frame(spark, [(0, [1.0], 1)])
    assert H.mine(one, one).count() == 0


def test_scores_that_no_number_holds_raise(spark):
    df = frame(spark, [(0, [2.0**20] * 4, 1), (1, [2.0**20] * 4, 1)])
    with pytest.raises(Exception, match="2\\^"):
        H.mine(df, df, scale=256).count()
