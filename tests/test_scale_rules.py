"""Two-level ranks, the search of near codes, and the fill of a held-out part, against plain versions."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from spanloom.operators import evidence, rank, trial


def frame(spark, seed=1, n=300):
    r = random.Random(seed)
    return spark.createDataFrame([(r.choice([1, 1, 1, 2, None]), i, r.choice("ab"), r.randint(0, 40)) for i in range(n)], "device long, id long, app string, value long")


def test_numbers_by_lot_are_row_numbers(spark):
    df = frame(spark)
    lot = rank.lots_of(df, "value", 8)
    got = rank.numbered(df, ["device"], ["value", "id"], [lot], "pos", "n").collect()
    rows = [(r.device, r.value, r.id) for r in df.collect()]
    for g in got:
        own = sorted(x[1:] for x in rows if x[0] == g.device)
        assert own[g.pos - 1] == (g.value, g.id) and g.n == len(own)
    assert len(got) == len(rows) and len({r[0] for r in df.select(lot).distinct().collect()}) > 4


def test_no_rank_has_all_rows_of_a_key_in_one_window(spark):
    df = frame(spark)
    plans = [rank.even_spread(df, ["device"], "id", 7), rank.bisect_order(df, ["device"], "id"), rank.context_priority(df, ["device"], ["app"], "id"), rank.stride_sample(df, ["device"], "id", 60)]
    plans += [rank.alternate(df.where("app = 'a'"), df.where("app = 'b'"), ["device"], "id"), rank.seeded_order(df, ["device"], "id", 7)]
    for p in plans:
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
        assert windows and all("__lot" in line or "lot" in line for line in windows), plan


def test_alternate_when_one_side_runs_out(spark):
    a, b = spark.range(5).withColumn("k", F.lit(1)), spark.range(10, 12).withColumn("k", F.lit(1))
    assert [r.id for r in rank.alternate(a, b, ["k"], "id").orderBy("ord").collect()] == [0, 10, 1, 11, 2, 3, 4]
    assert [r.id for r in rank.alternate(b, a, ["k"], "id").orderBy("ord").collect()] == [10, 0, 11, 1, 2, 3, 4]


@pytest.mark.parametrize("most,bits", [(0, 64), (1, 64), (2, 32), (4, 64), (8, 64)])
def test_near_codes_are_all_found(spark, most, bits):
    r = random.Random(most)
    codes = [r.getrandbits(bits) for _ in range(30)]
    for c in codes[:20]:
        for flips in (most, most + 1, max(0, most - 1)):
            x = c
            for at in r.sample(range(bits), flips):
                x ^= 1 << at
            codes.append(x)
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    got = {(p.a, p.b) for p in evidence.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, code long"), most, bits).collect()}
    assert got == {(i, j) for (i, x), (j, y) in combinations(enumerate(codes), 2) if (x ^ y).bit_count() <= most}


def test_keys_of_near_codes_are_long_and_few():
    for most in (1, 2, 3, 4):
        choices = evidence.block_choices(most)
        assert len(choices) <= evidence.KEYS and all(sum(w for _, w in c) >= 31 for c in choices)
    assert len(evidence.block_choices(4)) == 70 and len(evidence.block_choices(0)) == 1


def best(sizes, target):
    sums = {0}
    for n, c in sizes.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= target}
    return max(sums)


@pytest.mark.parametrize("seed", range(6))
def test_fill_reaches_the_largest_total(seed, monkeypatch):
    r = random.Random(seed)
    sizes = {n: r.randint(1, 9) for n in r.sample(range(1, 60), r.randint(1, 9))}
    for target in (0, 1, 7, 50, 133, 400):
        plan = trial.fill(sizes, target)
        assert all(0 < k <= sizes[n] for n, k in plan.items()) and sum(n * k for n, k in plan.items()) == best(sizes, target)
        assert plan == trial.fill(dict(sorted(sizes.items(), reverse=True)), target)
    monkeypatch.setattr(trial, "SUMS", 100)
    plan = trial.fill({1: 500, 7: 40, 90: 30}, 2500)
    assert sum(n * k for n, k in plan.items()) == 2500 and all(k <= {1: 500, 7: 40, 90: 30}[n] for n, k in plan.items())


def test_groups_are_held_whole(spark):
    rows = [(i, g) for i, g in enumerate([1] * 5 + [2] * 5 + [3] * 7 + [4] * 3 + [5] * 30)]
    got = trial.hold_out(spark.createDataFrame(rows, "id long, group long"), 0.3).collect()
    assert sum(g.held for g in got) == 15 and all(len({g.held for g in got if g.group == k}) == 1 for k in range(1, 6))
    assert not any(g.held for g in trial.hold_out(spark.createDataFrame(rows, "id long, group long"), 0.02).collect())


def plain_split(rows, today, quotas):
    days = sorted({r["day"] for r in rows if r["day"] < today})
    part = {x: "test" if x == days[-1] else "validation" if x == days[-2] else "train" for x in days}
    episode, before = {}, {}
    for r in sorted(rows, key=lambda r: (r["device"], r["at_us"], r["id"])):
        key, last = (r["app"], r["win"]), before.get(r["device"])
        name = last[2] if last and key == last[1] and r["at_us"] - last[0] <= 120_000_000 else r["id"]
        episode[r["id"]], before[r["device"]] = (r["device"], name), (r["at_us"], key, name)
    parts = {}
    for r in rows:
        if r["day"] in part:
            parts.setdefault(episode[r["id"]], set()).add(part[r["day"]])
    groups = {}
    for r in sorted(rows, key=lambda r: (r["at_us"], r["id"])):
        if r["day"] in part and r["ok"] and len(parts[episode[r["id"]]]) == 1:
            groups.setdefault((r["day"], r["app"], r["win"], r["at_us"] // 1_800_000_000), []).append(r)
    chosen, seen = [], []
    for split in ("test", "validation", "train"):
        buckets = {}
        for r in sorted((g[len(g) // 2] for k, g in groups.items() if part[k[0]] == split), key=lambda r: (r["at_us"], r["id"])):
            buckets.setdefault(r["app"], []).append(r)
        order = []
        while any(buckets.values()):
            order += [b.pop(len(b) // 2) for b in buckets.values() if b]
        count = 0
        for r in order:
            if count == quotas[split] or any((r["code"] ^ c).bit_count() <= 4 for c in seen):
                continue
            seen.append(r["code"])
            chosen.append((r["id"], split, episode[r["id"]][1]))
            count += 1
    return sorted(chosen)


def test_split_for_training_is_the_plain_one(spark):
    r = random.Random(8)
    base = [r.getrandbits(63) for _ in range(25)]
    rows, at = [], 5 * 86_400_000_000 - 4_000_000_000
    for i in range(260):
        at += r.choice([20, 60, 100, 400, 6000]) * 1_000_000
        code = r.choice(base) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63))
        rows.append({"id": i, "device": r.randint(1, 2), "at_us": at, "day": at // 86_400_000_000, "app": r.choice("abc"), "win": r.choice("xy"), "code": code, "ok": r.random() < 0.9})
    today = max(x["day"] for x in rows)
    quotas = {"test": 3, "validation": 4, "train": 9}
    got = trial.specialization_split(spark.createDataFrame(rows, "id long, device long, at_us long, day long, app string, win string, code long, ok boolean"), today, quotas).collect()
    assert sorted((g.id, g.split, g.episode) for g in got) == plain_split(rows, today, quotas) and len(got) > 8
    with pytest.raises(ValueError):
        trial.specialization_split(spark.createDataFrame(rows[:1], "id long, device long, at_us long, day long, app string, win string, code long, ok boolean"), 99, quotas)
