"""The trie and its totals against a plain trie, long chains, hot nodes, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spanloom.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, size int, part string"


def brute(rows, family=5, most=8):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    cut = lambda c: c - int(abs(c) % family) * (1 if c >= 0 else -1)
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        whole[c] = tuple(own.get(cut(c), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    total = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        total[path] = (max(1, sum(total[x][0] for x in below[path])), saved + sum(total[x][1] for x in below[path]))
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(below[path]), *total[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def found(df):
    return sorted((tuple(x) for x in df.collect()), key=lambda x: (x[1], x[0]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "p") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(T, "STRETCH", 3)
    monkeypatch.setattr(T, "IDS", 4)
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-12, 120), 70):
        for t in range(r.randint(1, 12)):
            rows.append((c, r.choice([t, t, None, 2]), r.choice(["user", "assistant", None]), r.choice(["a", "a", "b", "é", None, ""])))
    rows += rows[:9] + [(None, 1, "user", "no id")]
    assert found(T.conversation_trie(frame(spark, rows).repartition(3))) == brute(rows)


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(1000, t, "user", str(t)) for t in range(700)] + [(2000, t, "user", str(t) if t < 600 else "x") for t in range(650)]
    rows += [(5 * c, t, "user", "same") for c in range(30) for t in range(4)] + [(5 * c + 1, 0, "user", "h") for c in range(400, 420)]
    assert found(T.conversation_trie(frame(spark, rows))) == brute(rows)


def test_rounds_grow_with_the_bits_of_the_weight(spark, monkeypatch):
    """A chain of 2 000 turns takes no more rounds than its weight has bits."""
    rounds = []
    count = T.written

    def counted(df):
        if "side" in df.columns and "sum_n_leaves" not in df.columns and "next" in df.columns:
            rounds.append(1)
        return count(df)

    monkeypatch.setattr(T, "written", counted)
    rows = [(0, t, "user", "x") for t in range(2000)]
    assert found(T.conversation_trie(frame(spark, rows)))[0][5] == 1
    assert len(rounds) <= 2 * (2001 * 2002 // 2).bit_length()


def test_empty_and_turnless(spark):
    none = frame(spark, [(1, 1, "user", "x")]).limit(0)
    assert T.conversation_trie(none).count() == 0
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "gone")]
    assert found(T.conversation_trie(frame(spark, rows))) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
