"""Allocation against a plain version that meets each run with all evidence, for scopes of one shape and of several."""

import random

import pytest

from spanloom.operators import activity as A
from spanloom.operators import allocate as L

RUN = "device long, day long, id long, start_us long, end_us long, state string"
C = "device long, day long, start_us long, end_us long, label string"
H = "device long, day long, start_us long, end_us long, anchor_us long, label string"


def evidence(seed, shapes):
    r = random.Random(seed)
    runs, at = [], 0
    for i in range(30):
        at += r.choice([0, 0, 1, 7])
        runs.append((1, 0, i, at, at + r.randint(1, 12), r.choice(["active", "unattributed", "unattributed", "idle"])))
        at = runs[-1][4]
    spot = lambda: r.randint(-5, at + 5)
    c = [(1, r.choice([0, 0, 0, 1]), s, s + r.choice([0, 3, 9]), r.choice(["A", "B", None])) for s in (spot() for _ in range(14))]
    h = [(1, r.choice([0, 0, 0, 1]), a - b, a + f, a, r.choice("xy")) for a, (b, f) in ((spot(), r.choice(shapes)) for _ in range(20))]
    return runs, c, h


def plain(runs, c, h):
    out = []
    for dev, day, i, s, e, state in runs:
        over = lambda rows, s, e: [x for x in rows if x[:2] == (dev, day) and x[2] < e and s < x[3]]
        near = sorted({x[4] for x in over(h, s, e)})
        cuts = {t for x in over(c, s, e) + over(h, s, e) for t in x[2:4]} | {(a + b) // 2 for a, b in zip(near, near[1:])}
        edges = sorted({s, e} | {t for t in cuts if s < t < e})
        for p, q in zip(edges, edges[1:]):
            labels = {x[4] for x in over(c, p, q)} - {None} if state == "unattributed" else set()
            met = over(h, p, q)
            least = min((abs(x[4] - (p + q) // 2) for x in met), default=0)
            told = {x[5] for x in met if abs(x[4] - (p + q) // 2) == least} - {None}
            if state == "idle":
                tier, label = "nonforeground", None
            elif labels:
                tier, label = ("user_confirmed_label", min(labels)) if len(labels) == 1 else ("user_correction_conflict", None)
            else:
                tier, label = ("unclassified", None) if not told else ("model_inference", min(told)) if len(told) == 1 else ("model_conflict", None)
            out.append((dev, day, i, p, q, state, tier, label))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shapes", [[(4, 4)], [(0, 6)], [(4, 4), (0, 9), (-2, 5)]])
def test_allocation_is_what_meeting_all_gives(spark, shapes):
    for seed in range(3):
        runs, c, h = evidence(seed, shapes)
        got = L.allocate(*(spark.createDataFrame(x, k) for x, k in ((runs, RUN), (c, C), (h, H))), A.KEYS)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(runs, c, h)


def test_runs_do_not_meet_all_scopes_over_them(spark):
    runs, c, h = (spark.createDataFrame(x, k) for x, k in zip(evidence(1, [(4, 4)]), (RUN, C, H)))
    assert "Join" not in L.scope_pieces(runs, c, h, A.KEYS)._jdf.queryExecution().executedPlan().toString()


def test_no_evidence(spark):
    runs, _, _ = evidence(1, [(4, 4)])
    got = L.allocate(spark.createDataFrame(runs, RUN), spark.createDataFrame([], C), spark.createDataFrame([], H), A.KEYS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(runs, [], [])
