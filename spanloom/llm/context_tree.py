"""Language-model scores by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, each closed by a space, and one end. A byte is eight binary decisions; each of them
has a tree of contexts, the bytes before it from the nearest on, DEPTH at most. The context of a byte reaches back to the
space before its word, that of a word's first HEAD bytes on to the last TAIL bytes of the word before. In each node a
Krichevsky-Trofimov estimate is weighed, half and half, against the product of the node's children; what the trees give
after training is the probability of a bit: estimates of all depths, mixed by the weights that the training text gives them.

So a text's code length is a sum over its words' heads and words. Those are counted once over the corpus, the trees are
built on distinct contexts and bytes, each distinct unit is scored once, and documents sum what their units have.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import empty_text, give_back, groups, ready, removed, slices, utf8, written
from spanloom.llm.near_dup import _BASE, _BLANK, _BYTE, _INVERSE, _LOWER, _mix, _powers
from spanloom.llm.token_count import _least_common

#: Bytes of context at most, first bytes of a word that see the word before, and bytes of that word that they see. A context
#: and the byte after it are one number of 9 * DEPTH + 8 bits, so DEPTH is 6 at most.
DEPTH, HEAD, TAIL = 6, 3, 2
#: Context bytes that name a group of contexts whose trees one task builds below that depth.
GROUP = 2
#: A longer word is scored in pieces of so many bytes; bytes of text that a task takes at once.
LONG, STRETCH = 240, 1 << 22
#: Distinct units that a task holds before it passes them on.
HELD = 800_000
WORD, HEADS, PIECE = 0, 1, 2
#: The key of the end of a text, which no word has: word keys are hashes of at least 1.
END = 0
_SMALL = 4096
_HALVES = np.array([math.lgamma(i + 0.5) for i in range(_SMALL)])
_WHOLES = np.array([math.lgamma(i + 1) for i in range(_SMALL)])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 7."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def _ranges(data: np.ndarray):
    """Ranges of about STRETCH bytes that end at white space; a longer word is part of one range."""
    at = 0
    while at < len(data):
        to = min(at + STRETCH, len(data))
        while to < len(data) and not _BLANK[data[to - 1]]:
            found = np.flatnonzero(_BLANK[data[to : to + STRETCH]])
            to = to + int(found[0]) + 1 if len(found) else min(to + STRETCH, len(data))
        yield at, to
        at = to


def _tokens(column: pa.Array):
    """Lower-cased bytes of some texts; of each token, ends included: text, first byte, one past the last, and key."""
    data, ends = utf8(column)
    data = _LOWER[data]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for low, high in _ranges(data):
        part = data[low:high]
        blank = _BLANK[part]
        first = np.zeros(len(part) + 1, dtype=bool)
        first[ends[(ends >= low) & (ends <= high)] - low] = True
        begin = np.flatnonzero(~blank & (np.append(True, blank[:-1]) | first[:-1]))
        end = np.flatnonzero(~blank & (np.append(blank[1:], True) | first[1:])) + 1
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum(_BYTE[part] * _powers(_BASE, len(part)), dtype=np.uint64))
            h = _mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(part))[begin] + (end - begin).astype(np.uint64))
        found.append((begin + low, end + low, np.maximum(h >> np.uint64(1), np.uint64(1)).astype(np.int64)))
    begin, end, key = (np.concatenate(x) for x in zip(*found, strict=True))
    owner = np.searchsorted(ends, begin, side="right") - 1
    n = len(column)
    at = np.searchsorted(owner, np.arange(n), side="right")  # where each text's end goes
    return (
        data,
        np.insert(owner, at, np.arange(n)),
        np.insert(begin, at, ends[1:]),
        np.insert(end, at, ends[1:]),
        np.insert(key, at, END),
    )


def _heads(data: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys of heads: TAIL last bytes of the word before and HEAD first bytes of the token, 9 bits each (byte + 1, or 0 for
    none), below 0, so that no word has them."""
    wide = np.append(data, np.zeros(1, np.uint8)).astype(np.int64)
    code = np.zeros(len(owner), np.int64)
    same = np.zeros(len(owner), dtype=bool)
    same[1:] = owner[1:] == owner[:-1]
    for k in range(TAIL, 0, -1):
        at = np.append(0, end[:-1]) - k
        has = same & (at >= np.append(0, begin[:-1]))
        code = code << 9 | np.where(has, wide[np.where(has, at, 0)] + 1, 0)
    for k in range(HEAD):
        at = begin + k
        byte = np.where(at < end, wide[np.minimum(at, len(data))] + 1, np.where(at == end, 33, 0))
        byte = np.where(key == END, 11 if k == 0 else 0, byte)
        code = code << 9 | byte
    return code - (1 << 62)


def _pieces(word: bytes) -> list[tuple[int, int, bytes]]:
    """Key, bytes of context, and these and the bytes to score, of each piece of a long word after its head."""
    code = b" " + word + b" "
    out = []
    for at in range(1 + HEAD, len(code), LONG):
        skip = min(DEPTH, at)
        data = code[at - skip : at + LONG]
        with np.errstate(over="ignore"):
            raw = np.frombuffer(data, np.uint8)
            h = _mix(np.array([(_BYTE[raw] * _powers(_BASE, len(raw))).sum(dtype=np.uint64)], np.uint64), 7 + skip)
        out.append((max(int(h[0] >> np.uint64(1)), 1), skip, data))
    return out


def _taken(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of ranges of data."""
    size = end - begin
    ends = np.append(0, np.cumsum(size))
    at = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])


def _long_pieces(data, owner, begin, end) -> list[tuple[int, int, int, bytes]]:
    """(text, key, skip, data) of each piece of each long word."""
    return [(int(owner[i]), *piece) for i in np.flatnonzero(end - begin > LONG) for piece in _pieces(data[begin[i] : end[i]].tobytes())]


_UNITS = ["key", "kind", "skip", "data", "n"]


def _once(units: list[pa.Table]) -> pa.Table:
    """Units once by key, their counts summed."""
    whole = pa.concat_tables(units).combine_chunks()
    key = whole.column("key").to_numpy()
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    n = np.bincount(at, weights=whole.column("n").to_numpy(), minlength=len(first)).astype(np.int64)
    return whole.take(pa.array(first)).set_column(4, "n", pa.array(n))


def _slice_units(part: pa.RecordBatch) -> pa.Table:
    """The distinct units of some texts; n counts those of texts that teach."""
    data, owner, begin, end, key = _tokens(part.column("text"))
    teach = part.column("teach").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    n = np.bincount(at, weights=teach, minlength=len(first)).astype(np.int64)
    short = end[first] - begin[first] <= LONG
    words = pa.table([pa.array(key[first]), pa.array(np.full(len(first), WORD, np.int32)), pa.array(np.full(len(first), 1 + HEAD, np.int32)), _taken(data, begin[first], np.where(short, end[first], begin[first])), pa.array(n)], _UNITS)
    code, at = np.unique(_heads(data, owner, begin, end, key), return_inverse=True)
    n = np.bincount(at, weights=teach, minlength=len(code)).astype(np.int64)
    none = pa.array([b""] * len(code), pa.binary())
    heads = pa.table([pa.array(code), pa.array(np.full(len(code), HEADS, np.int32)), pa.array(np.zeros(len(code), np.int32)), none, pa.array(n)], _UNITS)
    out = [words, heads]
    if not short.all():
        told = part.column("teach").to_pylist()
        rows = [(k, PIECE, skip, x, int(told[i])) for i, k, skip, x in _long_pieces(data, owner, begin, end)]
        out.append(pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.int64())], _UNITS))
        out = [_once(out)]
    return pa.concat_tables(out)


def _units(batches):
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in slices(batch, "text", STRETCH):
            held.append(_slice_units(part))
            rows += held[-1].num_rows
            if rows > 2 * HELD:
                held = [_once(held)]
                rows = held[0].num_rows
                if rows > HELD:
                    yield from held.pop().to_batches(1 << 16)
                    rows = 0
    if held:
        yield from _once(held).to_batches(1 << 16)
    held.clear()
    give_back()


def _merged(batches):
    for whole in groups(batches, ["key"], 1 << 18):
        yield from _once([whole]).to_batches(1 << 16)


def _positions(batches):
    """For each byte to score of each unit: the number of its context and itself, the unit's key, and its count."""
    for batch in batches:
        for part in slices(batch, "data"):
            key, kind, skip, n = (part.column(c).to_numpy() for c in ("key", "kind", "skip", "n"))
            data, ends = utf8(part.column("data"))
            size = np.diff(ends)
            # One array of symbols (byte + 1, 0 for none): of words with their spaces, of heads out of their keys.
            of_word, of_head = (kind == WORD) & (size > 0), kind == HEADS
            length = np.where(of_word, size + 2, np.where(of_head, TAIL + 1 + HEAD, size))
            at = np.append(0, np.cumsum(length))
            symbols = np.full(at[-1] + DEPTH, 33, np.int64)
            symbols[at[-1] :] = 0
            who = np.repeat(np.arange(len(key)), size)
            symbols[at[:-1][who] + of_word[who] + np.arange(len(data)) - ends[:-1][who]] = data.astype(np.int64) + 1
            code = key[of_head] + (1 << 62)
            for k, place in enumerate([*range(HEAD - 1, -1, -1)]):
                symbols[at[:-1][of_head] + TAIL + 1 + place] = code >> 9 * k & 511
            for k in range(TAIL):
                symbols[at[:-1][of_head] + TAIL - 1 - k] = code >> 9 * (HEAD + k) & 511
            from_ = np.where(of_head, TAIL + 1, skip)
            count = np.maximum(length - from_, 0)
            who = np.repeat(np.arange(len(key)), count)
            place = np.arange(count.sum()) - np.repeat(np.append(0, np.cumsum(count))[:-1], count) + from_[who]
            ok = symbols[at[:-1][who] + place] > 0
            who, place = who[ok], place[ok]
            # A word's context ends at the space before it; of a head's, bytes that are not there end it.
            gram, open_ = np.zeros(len(who), np.int64), np.ones(len(who), dtype=bool)
            for k in range(1, DEPTH + 1):
                inside = place >= k
                s = np.where(inside, symbols[at[:-1][who] + np.maximum(place - k, 0)], 0)
                open_ &= s > 0
                gram = gram << 9 | np.where(open_, s, 0)
            gram = gram << 8 | symbols[at[:-1][who] + place] - 1
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(key[who]), pa.array(n[who])], ["gram", "key", "n"])


def _lgamma(n: np.ndarray, plus: float, table: np.ndarray) -> np.ndarray:
    """log gamma of n + plus; for larger n by Stirling's series."""
    out = table[np.minimum(n, _SMALL - 1)]
    large = n >= _SMALL
    if large.any():
        x = n[large] + plus
        out = out.copy()
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma(zeros, 0.5, _HALVES) + _lgamma(ones, 0.5, _HALVES) - _lgamma(zeros + ones, 1, _WHOLES) - math.log(math.pi)


def _node(below: np.ndarray, zeros: np.ndarray, ones: np.ndarray, leaf: bool) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability of nodes, and the weight of their own estimate."""
    own = kt(zeros, ones)
    if leaf:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def _trees(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list]:
    """The trees of whole groups below depth GROUP, of distinct sorted numbers of contexts and bytes, and their counts.

    Gives the probability of each of the eight bits of each row, mixed over depths GROUP to DEPTH, and for each bit the
    nodes at depth GROUP: first context byte, node of the byte's tree (1 to 255), zeros, ones, log probability.
    """
    mixed = np.full((len(gram), 8), 0.5)
    row = np.arange(len(gram))
    key, count, below = gram, n, np.zeros((8, len(gram)))
    tops = []
    for depth in range(DEPTH, GROUP - 1, -1):
        if depth < DEPTH:  # rows that differ in a farther byte only are one
            key, at = np.unique((key >> 17) << 8 | key & 255, return_inverse=True)
            count = np.bincount(at, weights=count, minlength=len(key)).astype(np.int64)
            below = np.stack([np.bincount(at, weights=b, minlength=len(key)) for b in below])
            row = at[row]
        byte = key & 255
        for j in range(8):
            new = np.append(True, (key[1:] >> 8 - j) != (key[:-1] >> 8 - j))
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            bit = byte >> 7 - j & 1
            total, ones = np.add.reduceat(count, first), np.add.reduceat(count * bit, first)
            log, weight = _node(np.add.reduceat(below[j], first), total - ones, ones, depth == DEPTH)
            chance = (np.where(bit == 1, ones[node], (total - ones)[node]) + 0.5) / (total[node] + 1)
            weight = weight[node]
            mixed[:, j] = weight[row] * chance[row] + (1 - weight[row]) * mixed[:, j]
            below[j] = 0
            below[j][first] = log
            if depth == GROUP:
                tops.append((key[first] >> 8 + 9 * (GROUP - 1), 1 << j | byte[first] >> 8 - j, total - ones, ones, log))
    return mixed, tops


def _grouped(counted: DataFrame) -> DataFrame:
    """Rows of one group of contexts in one task, sorted."""
    group = F.shiftright("gram", 8 + 9 * (DEPTH - GROUP))
    return counted.withColumn("top", group).repartition("top").sortWithinPartitions("top", "gram")


def _tops(batches):
    for whole in groups(batches, ["top"], 1 << 17):
        _, tops = _trees(whole.column("gram").to_numpy(), whole.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*tops, strict=True)], ["symbol", "node", "zeros", "ones", "log"])


def _upper(tops: DataFrame) -> tuple:
    """Of depths 0 and 1: the own weight and the chance of a one, by context byte and node of the byte's tree.

    One row by context byte and node comes to the driver, 257 * 255 at most.
    """
    own = tops.groupBy("symbol", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log")).toPandas()
    symbol, node = own.symbol.to_numpy(np.int64), own.node.to_numpy(np.int64)
    weight, chance, top_weight, top_chance = np.ones((258, 256)), np.full((258, 256), 0.5), np.ones(256), np.full(256, 0.5)
    zeros, ones = own.zeros.to_numpy(np.int64), own.ones.to_numpy(np.int64)
    log, weight[symbol, node] = _node(own.log.to_numpy(), zeros, ones, False)
    chance[symbol, node] = (ones + 0.5) / (zeros + ones + 1)
    all_zeros, all_ones, below = (np.bincount(node, weights=x, minlength=256) for x in (zeros, ones, log))
    all_zeros, all_ones = all_zeros.astype(np.int64), all_ones.astype(np.int64)
    _, top_weight = _node(below, all_zeros, all_ones, False)
    top_chance = (all_ones + 0.5) / (all_zeros + all_ones + 1)
    return weight, chance, top_weight, top_chance


def _gram_scores(upper):
    """log10 of the probability of each row's byte in its context."""

    def run(batches):
        weight, chance, top_weight, top_chance = upper.value
        for whole in groups(batches, ["top"], 1 << 17):
            gram = whole.column("gram").to_numpy()
            mixed, _ = _trees(gram, whole.column("n").to_numpy())
            symbol, byte = gram >> 8 + 9 * (DEPTH - 1), gram & 255
            total = np.zeros(len(gram))
            for j in range(8):
                node, one = 1 << j | byte >> 8 - j, (byte >> 7 - j & 1) == 1
                p, w = chance[symbol, node], weight[symbol, node]
                p = w * np.where(one, p, 1 - p) + (1 - w) * mixed[:, j]
                q, w = top_chance[node], top_weight[node]
                total += np.log10(w * np.where(one, q, 1 - q) + (1 - w) * p)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(total)], ["gram", "log"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Scores of the units of docs by the trees of those of its texts that are not held out.

    Returns (units, tokens, words): units is a written table of key, known (a word or end that training has), base (whether
    it is a word or end), n (its count in training) and log (log10 of its probability); tokens are all tokens in training,
    words the distinct ones. Null texts count as empty; rows of a null id teach nothing. Units of held-out texts are in
    the table, with the counts that training gives them. Without any training text all bits have chance 1/2.
    """
    ready(docs.sparkSession)
    teach = F.coalesce(~held_out(F.col(id_col)), F.lit(False))
    texts = docs.select(empty_text(text_col).alias("text"), teach.alias("teach"))
    schema = "key long, kind int, skip int, data binary, n long"
    units = written(texts.mapInArrow(_units, schema).repartition("key").sortWithinPartitions("key").mapInArrow(_merged, schema))
    places = units.mapInArrow(_positions, "gram long, key long, n long")
    grams = written(places.groupBy("gram").agg(F.sum("n").alias("n")))
    upper = docs.sparkSession.sparkContext.broadcast(_upper(_grouped(grams).mapInArrow(_tops, "symbol long, node long, zeros long, ones long, log double")))
    logs = _grouped(grams).mapInArrow(_gram_scores(upper), "gram long, log double")
    summed = places.select("gram", "key").join(logs, "gram").groupBy(F.col("key").alias("own")).agg(F.sum("log").alias("log"))
    base = F.col("kind") == WORD
    out = written(units.join(summed, F.col("key") == F.col("own"), "left").select("key", base.alias("base"), (base & (F.col("n") > 0)).alias("known"), "n", F.coalesce("log", F.lit(0.0)).alias("log")))
    removed(units, grams)
    told = out.where("known").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    return out, told.tokens or 0, told.words


def _sums(table, tokens: int, words: int):
    """Of each text: what the common units give, and the rest of its distinct units with their frequencies."""

    def run(batches):
        keys, base, known, log = table.value
        for batch in batches:
            for part in slices(batch, "text", STRETCH):
                data, owner, begin, end, key = _tokens(part.column("text"))
                rows = part.num_rows
                who, unit = np.concatenate([owner, owner]), np.concatenate([key, _heads(data, owner, begin, end, key)])
                more = _long_pieces(data, owner, begin, end)
                if more:
                    who, unit = np.append(who, [x[0] for x in more]), np.append(unit, [x[1] for x in more])
                at = np.minimum(np.searchsorted(keys, unit), max(len(keys) - 1, 0))
                hit = keys[at] == unit if len(keys) else np.zeros(len(unit), dtype=bool)
                at, own = at[hit], who[hit]
                sums = [np.bincount(own, weights=x[at], minlength=rows).astype(np.float64) for x in (known, base, log)]
                who, unit = who[~hit], unit[~hit]
                order = np.lexsort((unit, who))
                who, unit = who[order], unit[order]
                first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (unit[1:] != unit[:-1]))) if len(who) else np.zeros(0, np.int64)
                f = np.diff(np.append(first, len(who)))
                who, unit = who[first], unit[first]
                ids, marks = part.column("doc_id"), part.column("mark")
                yield pa.RecordBatch.from_arrays(
                    [ids, marks, pa.nulls(rows, pa.int64()), pa.array(np.ones(rows, np.int64)), pa.array(np.bincount(owner, minlength=rows)), *[pa.array(s) for s in sums]],
                    _FOUND,
                )
                take = pa.array(who)
                none = pa.nulls(len(who), pa.float64())
                yield pa.RecordBatch.from_arrays([ids.take(take), marks.take(take), pa.array(unit), pa.array(f), pa.nulls(len(who), pa.int64()), none, none, none], _FOUND)
        give_back()

    return run


_FOUND = ["doc_id", "mark", "key", "f", "n_tokens", "n_known", "base_score", "score"]


def score(docs: DataFrame, units: DataFrame, tokens: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score and score, with what fit() gave for the same docs.

    score is log10 of the text's probability (its words and its end), base_score that of single words, one added to each
    count. A null text is an empty one, of one token, its end. Rows that repeat give as many equal rows, and a null id is
    kept. Other columns are ignored. Empty tables give no rows. At most 2^18 of the commonest units are broadcast; the
    others are joined. Words of up to 63 equal hash bits would count as one word.
    """
    spark = ready(docs.sparkSession)
    per = math.log10(tokens + words + 1)
    told = units.select("key", F.when(F.col("base"), F.log10(F.col("n") + 1.0) - per).otherwise(0.0).alias("base"), F.col("known").cast("double").alias("known"), "log", "n")
    common = told.where(F.col("n") >= max(1, _least_common(told.where("n > 0")))).drop("n").toArrow().sort_by("key")
    table = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("key", "base", "known", "log")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(empty_text(text_col), F.octet_length(empty_text(text_col))).alias("mark"), empty_text(text_col).alias("text"))
    rows = texts.mapInArrow(_sums(table, tokens, words), "doc_id long, mark long, key long, f long, n_tokens long, n_known double, base_score double, score double")
    heads = rows.where("key IS NULL").drop("key").withColumnRenamed("f", "copies")
    f = F.col("f")
    tails = rows.where("key IS NOT NULL").select("doc_id", "mark", "key", "f").join(told, "key").select("doc_id", "mark", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_tokens"), (f * F.col("known")).alias("n_known"), (f * F.col("base")).alias("base_score"), (f * F.col("log")).alias("score"))
    summed = heads.unionByName(tails).groupBy("doc_id", "mark").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base_score", "score")])
    # Rows with one id and one text were summed together.
    one = lambda c: F.col(c) / F.col("copies")
    return summed.select(
        "doc_id", one("n_tokens").cast("long").alias("n_tokens"), F.round(one("n_known")).cast("long").alias("n_known"), one("base_score").alias("base_score"), one("score").alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    ).drop("copy")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fit() and score() in one: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    units, tokens, words = fit(docs, id_col, text_col)
    found = score(docs, units, tokens, words, id_col, text_col)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
