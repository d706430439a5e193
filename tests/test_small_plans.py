"""Searches of near codes find all pairs by a plan that stays small, as the driver holds it for every step."""

import random

from spanloom.operators.evidence import hamming_pairs


def test_near_codes_by_a_list_of_masks(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(12)]
    flip = lambda c, k: c ^ sum((1 << b) if b < 63 else -(1 << 63) for b in r.sample(range(64), k))
    codes = base + [flip(c, k) for c in base for k in (1, 4, 5)]
    got = hamming_pairs(spark.createDataFrame(list(enumerate(codes)), "id long, code long"), 4)
    want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if ((codes[a] ^ codes[b]) & ((1 << 64) - 1)).bit_count() <= 4}
    assert {(x.a, x.b) for x in got.collect()} == want and len(want) >= 24
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("shift") == 0 and len(plan) < 60_000, len(plan)
