"""Scores by context-tree weighting against a plain version of the same trees, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa

from spanloom.llm import context_tree as C

SCHEMA = "doc_id long, text string, n long, key string, kind int, log double, units string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(text))] + [None]


def places(words):
    """(context symbols from the nearest on, byte) of each byte of a text."""
    out, before = [], b""
    for w in words:
        code = b"\n" if w is None else w + b" "
        for i, byte in enumerate(code):
            back = [x + 1 for x in code[:i][::-1]] + [33] + ([x + 1 for x in before[-C.TAIL :][::-1]] if i < C.HEAD else [])
            out.append((tuple((back + [0] * C.DEPTH)[: C.DEPTH]), byte))
        before = w
    return out


def brute(rows):
    """{(doc_id, text): (n_tokens, n_known, base, score)} and N, by recursion over the trees."""
    teach = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for _, t in teach for w in tokens(t))
    n, v = sum(count.values()), len(count)
    grams = Counter(p for _, t in teach for p in places(tokens(t)))
    seen, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for context, byte in set(grams) | {p for _, t in rows for p in places(tokens(t))}:
        for d in range(C.DEPTH + 1):
            for j in range(8):
                node = (context[:d], 1 << j | byte >> 8 - j)
                seen[node][byte >> 7 - j & 1] += grams[context, byte]
                if d < C.DEPTH:
                    below[node].add((context[: d + 1], node[1]))

    def own(node):
        a, b = seen[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(node):
        if len(node[0]) == C.DEPTH:
            return own(node)
        x, y = own(node), sum(weighted(c) for c in below[node])
        return max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)

    def chance(context, node, bit, d=0):
        at = (context[:d], node)
        k = (seen[at][bit] + 0.5) / (sum(seen[at]) + 1)
        if d == C.DEPTH:
            return k
        w = math.exp(own(at) - math.log(2) - weighted(at))
        return w * k + (1 - w) * chance(context, node, bit, d + 1)

    @lru_cache(None)
    def log(context, byte):
        return sum(math.log10(chance(context, 1 << j | byte >> 8 - j, byte >> 7 - j & 1)) for j in range(8))

    out = {}
    for i, t in rows:
        found = tokens(t)
        out[i, t] = (len(found), sum(count[w] > 0 for w in found), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in found), sum(log(*p) for p in places(found)))
    return out, n


def texts(seed, size):
    r = random.Random(seed)
    words = ["the", "The", "of", "ofé", "x", "a", "zürich", "日本", "q" * 300, "w" * 239, "w" * 240, "w" * 241, "ab" * 400, "ab\x00c"]
    return [r.choice([" ", "\t", "\n\x0b", "   "]).join(r.choices(words, k=r.randint(0, 14))) for _ in range(size)] + [None, "", " \n ", "ONE", "x" * 3000, "the of " * 300]


def test_scores_are_those_of_the_plain_trees(spark):
    rows = [(i, t) for i, t in enumerate(texts(5, 60))] + [(7, "other text of one id"), (8, "twice"), (8, "twice"), (None, "the of no id")]
    df = spark.createDataFrame([(i, t, 5, "k", 9, 0.5, "u") for i, t in rows], SCHEMA)
    want, n = brute(rows)
    got = C.scored(df.repartition(3)).collect()
    assert len(got) == len(rows) and {g.train_tokens for g in got} == {n}
    found = defaultdict(list)
    for g in got:
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 7 == 2)
        found[g.doc_id].append((g.n_tokens, g.n_known, round(g.base_score, 6), round(g.score, 6)))
    assert {k: sorted(v) for k, v in found.items()} == {i: sorted((a, b, round(c, 6), round(d, 6)) for x, (a, b, c, d) in ((r, want[r]) for r in rows) if x[0] == i) for i, _ in rows}


def test_common_units_and_rare_ones_add_up(spark, monkeypatch):
    from spanloom.llm import token_count

    rows = [(i, t) for i, t in enumerate(texts(6, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    units, tokens_, words = C.fit(df)
    some = {g.doc_id: (g.n_known, round(g.base_score, 6), round(g.score, 6)) for g in C.score(df, units, tokens_, words).collect()}
    monkeypatch.setattr(token_count, "COMMON", 0)
    assert {g.doc_id: (g.n_known, round(g.base_score, 6), round(g.score, 6)) for g in C.score(df, units, tokens_, words).collect()} == some


def batch_of(rows):
    return pa.RecordBatch.from_arrays([pa.array([t or "" for t in rows], pa.string()), pa.array([i % 3 > 0 for i in range(len(rows))])], ["text", "teach"])


def test_long_texts_are_cut_at_words_only(monkeypatch):
    column = batch_of(texts(7, 30)).column("text")
    whole = [x.tolist() for x in C._tokens(column)]
    for most in (1, 16, 100):
        monkeypatch.setattr(C, "STRETCH", most)
        assert [x.tolist() for x in C._tokens(column)] == whole


def test_units_passed_on_early_sum_to_the_same(monkeypatch):
    def summed(held):
        monkeypatch.setattr(C, "HELD", held)
        found = Counter()
        for x in C._units(iter([batch_of(texts(seed, 20)) for seed in (1, 2, 3)])):
            for r in x.to_pylist():
                found[r["key"], r["kind"], r["skip"], r["data"]] += r["n"]
        return found

    assert summed(800_000) == summed(2)


def test_chances_of_all_bytes_sum_to_one(spark):
    """Of one context, the chances of all 256 bytes, for the trees of a small text."""
    import numpy as np

    grams = Counter()
    for context, byte in places(tokens("the theme of the thesis is there")):
        code = 0
        for s in context:
            code = code << 9 | s
        grams[code << 8 | byte] += 1
    context = next(iter(grams)) >> 8
    every = {context << 8 | b: 0 for b in range(256)} | dict(grams)
    key = np.array(sorted(every), np.int64)
    mixed, _ = C._trees(key, np.array([every[int(k)] for k in key], np.int64))
    assert abs(mixed[(key >> 8) == context].prod(axis=1).sum() - 1) < 1e-9


def test_empty_and_untaught(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert C.scored(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = C.scored(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).collect()[0]
    assert only.held_out and (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0) and only.base_score == 0
    assert abs(only.score - 6 * 8 * math.log10(0.5)) < 1e-9
