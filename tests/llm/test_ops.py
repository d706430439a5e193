"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import byte_bpe, langid, media, near_dup, packing, pii, token_count, topk, toxicity, units, url_filter

P = pytest.importorskip("public_tokenizers")
HARD = [None, "", " ", "\n\n\n", "a   b \n \n c  d<|endoftext|>  x    y", "<|startoftext|>, ok. don't", "e\u0301x \u00a0 z", "ÀÉ'S STRASSE İ ß;", "x" * 5000, "ab cd " * 20000, "same text here now ok", "same text here now ok"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, media string, unit string, sketch string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, None, None, "i", "m", "u", "s") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def hard(spark):
    d = docs_of(spark, HARD)
    return d.unionByName(d.limit(0)).unionByName(spark.createDataFrame([(None, "no id", None, None, None, "i", "m", "u", "s"), (3, "\n\n\n", None, None, None, "i", "m", "u", "s")], SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, ["x"]).limit(0)


def test_topk_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.integers(-2, 3, 8) / 4]) for i in range(400)] + [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (None, [0.0] * 8)]
    rows += [(2000 + i, rows[0][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), k=10).collect()
    ok = [(i, np.floor(1024 * np.array(v))) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    for q, v in ok:
        if q % 100 == 0:
            want = sorted(((-int(v @ w), i) for i, w in ok if i != q))[:10]
            assert [(-g.score, g.vec_id) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == want
    few = df.where("vec_id < 3 AND vec_id >= 0")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_meets_vectors_of_its_own_length(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    r = random.Random(12)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4 if i % 3 else 6)]) for i in range(60)] + [(0, [9.0] * 4), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("size", F.lit("clash")).withColumn("v", F.lit(1))
    asked = df.where("vec_id % 2 = 0")
    got = topk.top_k(df, asked, k=3).collect()
    own = {}
    for i, v in sorted(rows, key=lambda x: (x[0], x[1])):
        if v and i % 2 == 0:
            own.setdefault(i, v)
    assert {g.query_id for g in got} == set(own)
    for q, v in own.items():
        dot = lambda w: sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w, strict=True))  # noqa: E731,B023
        want = sorted((-dot(w), i) for i, w in rows if i != q and len(w) == len(v))[:3]
        assert [(-g.score, g.vec_id) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == want


def test_common_long_pretokens_are_not_shuffled(spark):
    """A long unit that all documents share is summed where it is read, by its digest."""
    import types

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    shared, own = "ab-" * 100, ["x" * 70 + str(i) for i in range(4)]
    texts = [f"{shared} {o} {shared} end" for o in own]
    n = len(Tokenizer.from_file(path).encode(" " + shared, add_special_tokens=False).ids)
    known = types.SimpleNamespace(value={token_count.key(" " + shared): n, " end": 1})
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), pa.array(texts)], ["doc_id", "mark", "text"])
    rows = [r for b in token_count._frequencies(path, known)(iter([batch])) for r in b.to_pylist()]
    assert [r["done"] for r in rows if r["unit"] is None] == [n + 1] * 4  # the first one has no space before it
    assert Counter(r["unit"] for r in rows if r["unit"] is not None) == Counter([token_count.key(shared)] * 4 + [token_count.key(" " + o) for o in own])
    got = {g.doc_id: g.n_tokens for g in token_count.count_tokens(docs_of(spark, texts), path).collect()}
    assert got == {i: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def base_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(g) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(g[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_brute_force(spark, hard, none):
    r = random.Random(3)
    alphabet = ["a@b.co", "1.2.3.4", ".5", "999", "4111 1111 1111 1111", "+1 (202) 555-0143", " ", "-", "@", ".", "é", "_", "+", "x", "4111-1111-1111-1112", "\n", "😀"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 30))) for _ in range(300)]
    texts += ["GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "my ssn 123-45-6789", "order 123-45-6789", "a.a" * 50000, "1 " * 50000, "+1" + " " * 50000]
    got = {g.doc_id: g for g in pii.report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts[:304]):
        want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert (got[i].n_email, got[i].n_card) == (want.count("email"), want.count("card"))
    assert [got[i].n_iban for i in (300, 301)] == [1, 0] and [got[i].n_nid for i in (302, 303)] == [1, 0]
    assert pii.report(hard).count() == 14 and pii.report(none).count() == 0
    masked = {m.doc_id: m.text for m in pii.masked(docs_of(spark, ["to a@b.co now 1.2.3.4.", None, "plain"])).collect()}
    assert masked == {0: "to <email> now <ip>.", 1: None, 2: "plain"}


def test_pii_addresses_with_zero_parts(spark):
    r = random.Random(9)
    alphabet = ["0", "00", "000", "255", "256", "0255", "01", "10", ".", ".", ".", " ", "10.0.0.1", "000.1.2.3", "0.0.0.0", "x"]
    texts = ["host 10.0.0.1", "192.168.0.5", "127.0.0.1", "0.0.0.0", "000.1.2.3", "1.2.3.0256", "0" * 3000 + ".0.0." + "0" * 3000]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 20))) for _ in range(300)]
    got = {g.doc_id: g for g in pii.report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].n_ip == want.count("ip"), (t, want, got[i].spans)
    assert [got[i].n_ip for i in range(7)] == [1, 1, 1, 1, 1, 0, 1]
    assert {m.text for m in pii.masked(docs_of(spark, texts[:5])).collect()} == {"host <ip>", "<ip>"}


def test_units_join_back():
    for t in HARD:
        assert "".join(units.units(t or "")) == (t or "")
        assert "".join(units.stretches(t or "", 7)) == (t or "")


def test_token_counts(spark, hard, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = Counter((g.doc_id, g.n_bytes, g.n_tokens, g.over_limit) for g in token_count.count_tokens(hard, path).collect())
    want = Counter()
    for r in hard.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 1024)] += 1
    assert got == want
    assert token_count.count_tokens(none, path).count() == 0


def test_token_counts_broadcast_no_long_texts(spark, monkeypatch):
    from pyspark import SparkContext
    from tokenizers import Tokenizer

    sent = []
    plain = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or plain(self, value))
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["漢字仮名" * 500, "漢字仮名" * 500, "é" * 32, "é" * 33, "x" * 64, "x" * 65, "base64" * 2000, "some short words here", "some " + "y" * 3000 + " more"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.count_tokens(docs_of(spark, texts), path).collect()}
    assert got == {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in enumerate(texts)}
    tables = [x for x in sent if isinstance(x, dict)]
    assert tables and max(len(u.encode()) for x in tables for u in x) <= 64


def test_token_counts_of_many_rows_without_an_id(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [f"row {i % 40} of many {'x' * (i % 7)}" for i in range(400)]
    df = spark.createDataFrame([(None, x) for x in texts], "doc_id long, text string")
    got = Counter((g.n_bytes, g.n_tokens) for g in token_count.count_tokens(df, path).collect())
    assert got == Counter((len(x), len(t.encode(x, add_special_tokens=False).ids)) for x in texts)


def test_byte_bpe_digests(spark):
    """The query's columns against the library and hashlib, with long runs and every kind of white space."""
    path = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoding(path, P.PATTERN)
    r = random.Random(8)
    white = "\t\n\x0b\x0c\r \x1c\x1f\x85\xa0\u2003\u3000\u200b"
    texts = ["".join(r.choice(["ab", "'s", "1", "!", " x", r.choice(white) * r.choice([1, 2, 9999, 10_000, 12_000])]) for _ in range(r.randint(1, 8))) for _ in range(80)]
    got = {g.doc_id: g for g in byte_bpe.digests(docs_of(spark, texts), path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    for t in (" " * 2_000_000, "\n" * 2_000_000 + "x", "a" * 2_000_000):
        assert enc.decode_bytes(byte_bpe.encode_text(t, path, P.PATTERN)) == t.encode()


def test_byte_bpe_round_trip(spark, hard, none):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoding(path, P.PATTERN)
    both = byte_bpe.decode(byte_bpe.encode(hard, path, P.PATTERN), path, P.PATTERN)
    assert both.columns == [*[c for c in hard.columns if c != "ids"], "ids", "decoded"]
    for r in both.collect():
        assert bytes(r.decoded) == (r.text or "").encode() and r.ids == enc.encode_ordinary(r.text or "")
    assert byte_bpe.digests(hard, path, P.PATTERN).count() == 14 and byte_bpe.digests(none, path, P.PATTERN).count() == 0
    long = " ".join(random.Random(5).choice(["ab", "c\n", "", "\n \n", "   x", "é'll"]) for _ in range(50000))
    assert byte_bpe.encode_text(long, path, P.PATTERN) == enc.encode_ordinary(long)


def test_packing(spark, hard, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(hard, path).toPandas()
    want = Counter()
    for r in hard.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))] += 1
    assert Counter((None if np.isnan(x.doc_id) else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_whole_and_tight(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 100): r.randint(1, 200) for _ in range(40)}
    rows = packing.plan(counts, 100)
    bins: dict[int, list] = {}
    for length, first, n, seq, each, off in rows:
        for i in range(n):
            bins.setdefault(seq + i // each, []).append((off + i % each * length, length))
    assert Counter(n for b in bins.values() for _, n in b) == Counter(counts)
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 100
    # Not more than best fit, longest first, one piece at a time.
    gaps: list[int] = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        k = min((g for g in gaps if g >= n), default=None)
        if k is not None:
            gaps.remove(k)
        gaps.append((100 if k is None else k) - n)
    assert len(bins) <= len(gaps) * 1.01 + 1


def test_url_filter(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block")]
    urls = ["http://A.Example.COM/en/71?x", "https://b.com/en/5#t", "http://x.net/de/9", "http://example.net/de/81", "http://notexample.net/de/81", None, "", "no scheme", "http://com/en", "ftp://q.org?x=1://z/en/", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(2)
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(df, rules).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7") and got[1] == ("b.com", "/en/5", "com/en/")
    assert got[2][2] == "net/de/" and got[3][2] == "example.net/de/8" and got[4][2] == "net/de/"
    assert got[5] == got[6] == got[7] == ("", "", None) and got[8] == ("com", "/en", None) and got[9] == ("q.org", "", None) and got[10] == ("b:", "//c/d", None)
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(df, rules).collect()}
    assert [verdicts[i] for i in range(5)] == ["allow", "block", "allow", "block", "allow"] and set(verdicts.values()) <= {"allow", "block"}
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"} and url_filter.judge(df.limit(0), rules).count() == 0


def test_url_filter_brute_force(spark):
    """Hosts, paths, rules and rule verdicts of random urls, and lexical features, against plain Python."""
    r = random.Random(21)
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    parts = ["http", "://", "/", "?", "#", "Example.COM", "example.net", ".org", "x.", "/en/", "/de/8", "/es/", "7", "&a=1", "é", "a" * 30]
    urls = [None, "", *("".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(500)), *(f"http://s{i % 7}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es'])}/{i}" for i in range(300))]
    got = {g.page_id: g for g in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fit = [(len(x), x, v) for x, v in rules for h, p in [x.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fit, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1]), u
        assert got[i].verdict in ("allow", "block") and (best is None or got[i].verdict == best[2])
    told = url_filter._lexical(spark.createDataFrame([(u or "", "h.co", "/a-b/cc") for u in urls], "u string, host string, path string")).select("u", "length", "digits", "params", "dashes", "entropy", "depth", "longest").collect()
    for x in told:
        share = [n / max(1, len(x.u)) for n in Counter(x.u).values()]
        query = re.search(r"\?([^#]*)", x.u)
        assert (x.length, x.dashes, x.depth, x.longest) == (len(x.u), sum(c in "-_" for c in x.u), 2, 2)
        assert x.params == len([p for p in (query[1] if query else "").split("&") if p]) and abs(x.digits - sum(c in "0123456789" for c in x.u) / max(1, len(x.u))) < 1e-12
        assert abs(x.entropy + sum(s * np.log2(s) for s in share)) < 1e-9


def test_url_filter_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (2, "http://b.io/z"), (2, "http://b.io/z"), (None, None)], "page_id long, url string").withColumn("suffix", F.lit("c")).withColumn("a.b", F.lit(1))
    got = url_filter.judge(df, [("com/en/", "block"), ("io/q", "allow")]).collect()
    assert len(got) == 5 and len({(g.page_id, g.verdict) for g in got}) == 3


def test_url_filter_counts_every_site(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SUFFIXES", 6)
    told = [["allow", "block"][i % 2] for i in range(40)]
    rules = [(f"t{i:02d}/x", what) for i, what in enumerate(told)]
    asked = [f"http://s.t{i:02d}/y0" for i in range(40)]
    rows = [f"http://s.t{i:02d}/x{k % 10}" for i in range(40) for k in range(20 if i < 6 else 12)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(asked + rows)], "page_id long, url string")
    got = [r.verdict for r in url_filter.judge(df, rules).orderBy("page_id").collect()]
    assert len(got) == len(asked + rows) and got[:40] == told


def test_url_filter_on_repeated_urls(spark, monkeypatch):
    """Above the sample's bound: one url with most rows, two urls alone, and one repeated verdict; every row has a verdict."""
    monkeypatch.setattr(url_filter, "TRAIN_ROWS", 30)
    monkeypatch.setattr(url_filter, "LEAST_ROWS", 5)
    rules = [("com/en/", "block"), ("net/de/", "allow")]
    for k in range(4):
        two = [f"http://a{k}.com/en/x"] * 400 + [f"http://b{k}.net/de/y"] * 300 + [f"http://c{k}.org/z"]
        for urls in (two, two + [f"http://s{i}.net/de/{i}" for i in range(300)]):
            got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
            assert len(got) == len(urls) and {g.verdict for g in got if g.page_id < 400} == {"block"} and {g.verdict for g in got if 400 <= g.page_id < 700} == {"allow"}
    labelled = spark.createDataFrame([(f"u{i}" if i % 50 else f"b{i}", "h", "p", float(i % 50 == 0)) for i in range(1000)] * 2, "u string, host string, path string, y double")
    chosen = url_filter._sample(labelled).collect()
    assert {c.copies for c in chosen} == {2} and sum(c.y for c in chosen) == 5 and len({c.u for c in chosen}) == len(chosen) == 34


def test_url_filter_on_withheld_urls(spark):
    """Urls that rules decide, one in five withheld: the trees' verdicts on those."""
    r = random.Random(31)
    rules = [("com/shop/", "block"), ("net/docs/", "allow"), ("org/win/", "block"), ("io/read/", "allow")]
    urls = []
    for i in range(600):
        tld, word = r.choice([("com", "shop"), ("net", "docs"), ("org", "win"), ("io", "read")])
        tail = "&".join(f"q{r.randint(0, 99)}={r.randint(0, 9999)}" for _ in range(6)) if word in ("shop", "win") else ""
        urls.append(f"http://h{r.randint(0, 40)}.{tld}/{word}/{i}?{tail}")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [g for g in url_filter.judge(df, rules, withhold=F.col("page_id") % 5 == 0).collect() if g.page_id % 5 == 0]
    assert len(got) == 120 and np.mean([(g.score >= 0.5) == (g.verdict == "block") for g in got]) > 0.95


WORDS = {"en": "the and that with from this which over there when", "fr": "les des avec pour dans être était voilà où ça", "de": "der die und nicht über schön auch noch wäre für"}


def test_langid(spark, hard, none):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(WORDS[x].split()) for _ in range(12)), x) for i, x in ((i, r.choice("en fr de".split())) for i in range(600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = langid.predict(df.withColumn("lang_pred", F.lit("old")), model).where(langid.held_out()).collect()
    assert np.mean([g.lang == g.lang_pred for g in got]) > 0.95 and all(0 <= g.lang_score <= 1 for g in got)
    odd = {h.doc_id: h.lang_pred for h in langid.predict(hard, model).collect()}
    assert odd[0] == odd[1] == odd[2] == "und" and odd[8] in WORDS
    assert langid.fit(none) is None and {h.lang_pred for h in langid.predict(hard, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_ftrl_against_a_plain_one(monkeypatch):
    """Weights of the vectorised learner against one number at a time."""
    monkeypatch.setattr(langid, "FEATURES", 12)
    monkeypatch.setattr(langid, "EPOCHS", 2)
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.random(4)) for _ in range(40)]
    y = r.integers(0, 3, 40)
    w, b = langid.ftrl(rows, y, 3)
    z, n = np.zeros((13, 3)), np.zeros((13, 3))
    weight = lambda f, k: 0.0 if abs(z[f, k]) <= langid.L1 else -(z[f, k] - np.sign(z[f, k]) * langid.L1) / ((langid.BETA + np.sqrt(n[f, k])) / langid.ALPHA + langid.L2)
    order = np.random.default_rng(11)
    for _ in range(2):
        for i in order.permutation(40):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True), (12, 1.0)]
            now = {(f, k): weight(f, k) for f, _ in x for k in range(3)}
            s = np.array([sum(v * now[f, k] for f, v in x) for k in range(3)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for f, v in x:
                for k in range(3):
                    g = (p[k] - (y[i] == k)) * v
                    sigma = (np.sqrt(n[f, k] + g * g) - np.sqrt(n[f, k])) / langid.ALPHA
                    z[f, k] += g - sigma * now[f, k]
                    n[f, k] += g * g
    want = np.array([[weight(f, k) for k in range(3)] for f in range(13)])
    assert np.allclose(want[:-1], w) and np.allclose(want[-1], b) and (w == 0).any()


def test_langid_scores_against_the_model(spark):
    r = random.Random(13)
    df = spark.createDataFrame([(i, " ".join(r.choice(WORDS[x].split()) for _ in range(r.randint(1, 9))), x) for i, x in ((i, r.choice("en fr de".split())) for i in range(300))], "doc_id long, text string, lang string")
    model = langid.fit(df.withColumn("a.b", F.lit(1)))
    for g in langid.predict(df.withColumn("a.b", F.lit(1)), model).collect():
        c = langid.counts(g.text)
        x = np.log1p(c) * model.idf
        x /= np.sqrt((x * x).sum())
        full = np.zeros((langid.FEATURES, len(model.languages)))
        for f in np.flatnonzero(np.diff(model.first)):
            k = slice(model.first[f], model.first[f + 1])
            full[f, model.classes[k]] = model.weights[k]
        s = (x @ full + model.bias) / model.temperature
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert g.lang_pred == model.languages[p.argmax()] and abs(g.lang_score - p.max()) < 1e-9


def test_langid_sample_is_bounded_by_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 20)
    seen = []
    plain = langid.in_one_task
    monkeypatch.setattr(langid, "in_one_task", lambda rows, make: seen.append({r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}) or plain(rows, make))
    rows = [(i if i % 5 else None, f"{WORDS['en' if i % 4 else 'fr']} {i}", "en" if i % 4 else "fr") for i in range(800)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen == [{"en": 20, "fr": 20}]


def test_langid_learns_from_languages_of_repeated_rows(spark, monkeypatch):
    """A language of one row a thousand times is learned, and does not crowd another one out."""
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 10)
    seen = []
    plain = langid.in_one_task
    monkeypatch.setattr(langid, "in_one_task", lambda rows, make: seen.append({r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}) or plain(rows, make))
    keep = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    for k in keep[:4]:
        rows = [(k, WORDS["de"], "de")] * 1000 + [(1000 + i, f"{WORDS['en']} {i}", "en") for i in range(100)]
        assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).languages == ["de", "en"]
    alone = langid.fit(spark.createDataFrame([(keep[0], WORDS["de"], "de")] * 1000, "doc_id long, text string, lang string"))
    assert alone.languages == ["de"] and {s["de"] for s in seen} == {1} and {s.get("en", 10) for s in seen} == {10}


def test_langid_learns_every_language(spark):
    r = random.Random(7)
    words = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for k in range(80)}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(15)), x) for i, x in enumerate(x for x in words for _ in range(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = langid.predict(df, model).where(langid.held_out()).collect()
    assert model.languages == sorted(words) and np.mean([g.lang == g.lang_pred for g in got]) > 0.9
    one = spark.createDataFrame([*rows, *[(10_000 + i, "ϕω χψ ϕω", "once") for i in range(3)]], "doc_id long, text string, lang string")
    assert "once" in langid.fit(one).languages


def test_media(spark, hard, none):
    for n in (0, 1, 63, 64, 1393, 1417, 5000, 100_001):
        data = bytes(i * 7 % 256 for i in range(n))
        p = media.padded(data)
        s = media.write_stream(p, n)
        x = media.read_stream(s)
        assert x["payload"] == p and x["n_bytes"] == n and x["crc_bad"] == 0 and x["resyncs"] == 0 and x["table"]["frames"] == len(x["offsets"])
        assert all(media.header(s, at) for at in x["offsets"]) and x["samples"] == 1152 * len(x["offsets"])
    s = media.write_stream(media.padded(b"q" * 5000), 5000)
    at = media.read_stream(s)["offsets"]
    junk = s[: at[1]] + b"\xff\xfbjunk\xff" + s[at[1] :]
    y = media.read_stream(junk)
    assert y["resyncs"] >= 1 and y["skipped"] == 7 and len(y["offsets"]) == len(at)
    broken = bytearray(s)
    broken[at[0] + 8] ^= 1
    assert media.read_stream(bytes(broken))["crc_bad"] == 1
    for r in media.describe(media.store(hard)).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 and r.duration_s > 0
    assert media.store(none).count() == 0 and media.describe(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().media_bytes == 0


def test_media_digests(spark):
    """The query's columns against hashlib and zlib, over texts that look like tags and tables at every phase."""
    texts = [(w * 1500)[k : k + n] for w in ("TAG", "ID3", "Xing", "VBRI", "Info", "é") for k in range(len(w)) for n in (0, 1, 67, 127, 128, 129, 1390, 1417, 3000)]
    for g in media.describe(media.store(docs_of(spark, texts))).collect():
        raw = texts[g.doc_id].encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stream = media.write_stream(p, len(raw))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest()) and "crc=" in g.feature


def test_media_reads_other_streams(spark):
    s = media.write_stream(media.padded(b"q" * 5000), 5000)
    old = media.read_stream(s + b"TAG" + b"t" * 125)
    assert "TAG" in old["tags"] and old["skipped"] == 0 and old["payload"] == media.padded(b"q" * 5000)
    assert media.read_stream(s[:-700])["payload"] is None
    short = media.describe(spark.createDataFrame([(1, bytearray(s[:-700]))], "doc_id long, media binary")).first()
    assert short.payload_bytes is None and short.payload_sha256 is None and short.media_bytes == len(s) - 700
    # Version 2.3 has plain sizes: 200 is no syncsafe number.
    body = b"TIT2" + (200).to_bytes(4, "big") + b"\0\0" + b"a" * 200 + b"TPE1" + (3).to_bytes(4, "big") + b"\0\0" + b"abc"
    assert media.read_stream(b"ID3\x03\0\0" + media._syncsafe(len(body)) + body + s)["tags"] == ["TIT2", "TPE1"]
    # A VBRI table, and Layer I frames with a right and a wrong checksum.
    vbri = b"\xff\xfb" + bytes([0x90, 0xC0]) + bytes(32) + b"VBRI" + bytes(6) + (9000).to_bytes(4, "big") + (33).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2) + b"\x01\x00\x00\x02"
    frame = vbri + bytes(media.header(vbri, 0)[2] - len(vbri))
    t = media.read_stream(frame)["table"]
    assert (t["frames"], t["bytes"], t["steps"]) == (33, 9000, [256, 2])
    head, cover = b"\xff\xfe" + bytes([0x40, 0xC0]), bytes(16)
    size = media.header(head + bytes(4), 0)[2]
    good = head + media.crc16(head[2:] + cover).to_bytes(2, "big") + cover
    both = good + bytes(size - len(good)) + head + b"\0\1" + cover + bytes(size - 6 - len(cover))
    x = media.read_stream(both)
    assert (x["crc_good"], x["crc_bad"], len(x["offsets"])) == (1, 1, 2)


def test_toxicity_scores_against_the_model(spark):
    """Scores from compressed lengths, one window at a time."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    texts = [" ".join([*(word() for _ in range(r.randint(0, 60))), *(["zorkblat quixgrump"] * (i % 3 == 0))]) for i in range(200)] + ["", " ", "a" * 3000]
    model = toxicity.train([t.encode() for t in texts[::3]], [t.encode() for i, t in enumerate(texts) if i % 3], 0.2)
    plain, both = toxicity._compressor(model.ordinary), toxicity._compressor(model.ordinary + model.toxic)
    df = docs_of(spark, texts).withColumn("a.b", F.lit(1))
    for g in toxicity.score(df, model).collect():
        w = toxicity.windows(texts[g.doc_id].encode())
        gain = sorted((len(plain.compress(x)) - len(both.compress(x)) for x in w), reverse=True)
        over = [sum(x >= t for x in gain) for t in (3, 4, 5, 6, 7)]
        top = (gain + [0, 0, 0])[:3]
        x = np.array([*top, np.mean(gain), np.log(len(gain)), over[0] / len(w), over[2] / len(w), over[1] > 0, over[2] > 0, over[3] > 0, np.log1p(over[1]), np.log1p(over[2]), np.log1p(over[4])], float)
        z = float(np.append((x - model.centre) / model.spread, 1.0) @ model.weights)
        assert abs(g.toxicity - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9, texts[g.doc_id][:40]


def test_toxicity_finds_withheld_documents():
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    away = lambda r: zlib.crc32(str(r[0]).encode()) % 3 == 1
    some = [[t[: toxicity.ROW_CHARS].encode() for i, t, y in rows if y == k and not away((i,))] for k in (1, 0)]
    m = toxicity.train(*some, len(some[0]) / (len(some[0]) + len(some[1])))
    x = toxicity._Scorer(m.ordinary, m.toxic).features([r[1].encode() for r in rows if away(r)])
    told = 1 / (1 + np.exp(-np.c_[(x - m.centre) / m.spread, np.ones(len(x))] @ m.weights)) >= toxicity.THRESHOLD
    y = np.array([r[2] == 1 for r in rows if away(r)])
    assert told[y].mean() > 0.45 and told[~y].mean() < 0.02


def test_toxicity_excerpts_spread_over_long_texts(spark):
    text = "".join(f"{i:06d} " for i in range(30_000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "i long, t string")
    got = {x.i: x.e for x in df.select("i", toxicity.excerpt(F.col("t")).alias("e")).collect()}
    assert got[2] == "short" and got[3] is None and len(got[1]) < 51_000
    size = toxicity.ROW_CHARS // toxicity.STRETCHES
    pieces = [got[1][k * (size + 1) : k * (size + 1) + size] for k in range(toxicity.STRETCHES)]
    assert all(p in text for p in pieces) and pieces[0] == text[:size] and pieces[-1] == text[-size:] and len(set(pieces)) == len(pieces)


def test_toxicity(spark, hard, none):
    r = random.Random(4)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    rows, marks = [], []
    for i in range(900):
        w = [word() for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w[r.randrange(80)] = r.choice(["zorkblat", "quixgrump", "vubbish"])
        rows.append((i, " ".join(w))), marks.append((i, 1, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).where(zl_held()).collect()
    y, s = np.array([g.doc_id % 4 == 0 for g in got]), np.array([g.toxicity for g in got])
    assert s[y].mean() > 0.8 and s[~y].mean() < 0.2 and ((s >= 0) & (s <= 1)).all()
    assert toxicity.score(hard.withColumn("toxicity", F.lit("x")), model).count() == 14 and toxicity.score(none, model).count() == 0
    assert toxicity.fit(df, labels.where("toxic = 0")) is None and toxicity.score(hard, None).agg(F.max("toxicity")).first()[0] == 0


def zl_held():
    return toxicity.held_out(F.col("doc_id").cast("string").cast("binary"))


def shingle_set(t):
    w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(sets, percent=85):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, hard, none):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(20):
        base = [word() for _ in range(r.choice([3, 8, 40, 120, 400]))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    centre = [word() for _ in range(100)]
    for i in range(150):  # a large group of near copies at all distances
        copy = list(centre)
        for _ in range(i % 6):
            copy[r.randrange(100)] = word()
        texts.append(" ".join(copy) if i % 3 else "  ".join(copy).upper())
    texts += [" ".join([*passage, *[word() for _ in range(30)]]) for _ in range(60)] + ["", None, "one", "One", "two three"]
    df = docs_of(spark, texts, 10)
    got = {g.doc_id: g for g in near_dup.near_duplicates(df).collect()}
    sets = {i + 10: shingle_set(t) for i, t in enumerate(texts)}
    assert {i: g.n_shingles for i, g in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: g.component_id for i, g in got.items()} == components_of(sets)
    assert all(g.kept == (g.doc_id == g.component_id) for g in got.values())
    odd = near_dup.near_duplicates(hard).collect()
    assert len(odd) == 14 and {o.component_id for o in odd if o.doc_id in (10, 11)} == {10} and [o.kept for o in odd if o.doc_id is None] == [True]
    assert near_dup.near_duplicates(none).count() == 0


def test_large_groups_with_strangers_lose_no_link(spark, monkeypatch):
    """Blocks of a few: members that the pivot does not join meet all others."""
    from spanloom.operators import components as C

    monkeypatch.setattr(near_dup, "BLOCK", 5)
    monkeypatch.setattr(C, "LEAST_HOT", 4)
    r = random.Random(31)
    centre = [f"w{i}" for i in range(120)]
    texts, now = [], list(centre)
    for i in range(90):  # a chain that drifts away from its first text, links between neighbours only
        now[r.randrange(120)] = f"d{i}"
        texts.append(" ".join(now))
    for _ in range(40):
        copy = list(centre)
        for _ in range(r.randint(0, 8)):
            copy[r.randrange(120)] = f"x{r.random()}"
        texts.append(" ".join(copy))
    r.shuffle(texts)
    got = {g.doc_id: g.component_id for g in near_dup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == components_of({i: shingle_set(t) for i, t in enumerate(texts)})


def test_near_pairs_at_the_threshold_are_met(spark):
    """Pairs just above and just below 85 per cent, of sets of several sizes: all above are linked, none below."""
    r = random.Random(33)
    texts, want, i = [], {}, 0
    for n in (20, 60, 200, 1000):
        for _ in range(40):
            base = [f"{n}b{r.random()}" for _ in range(n + 4)]
            m = next(m for m in range(1, n) if 100 * (n - m) < 85 * (n + m))  # shingles that an ending of m new words changes
            for cut, linked in ((m - 1, True), (m, False)):
                texts += [" ".join(f"{cut}{w}" for w in base), " ".join([f"{cut}{w}" for w in base[: len(base) - cut]] + [f"z{r.random()}" for _ in range(cut)])]
                want |= {i: i, i + 1: i if linked else i + 1}
                i += 2
    got = {g.doc_id: g.component_id for g in near_dup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == want


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    r = random.Random(8)
    centre = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        copy = list(centre)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(100)] = f"x{r.random()}"
        texts.append(" ".join(copy))
    got = {g.doc_id: g.component_id for g in near_dup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == components_of({i: shingle_set(t) for i, t in enumerate(texts)})
