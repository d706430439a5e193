"""Best-fit packing of tokenised documents into sequences of one capacity.

Only lengths matter for packing, so the plan is made from the histogram of piece lengths: as many numbers as the
capacity, whatever the corpus. Pieces then find their places by their rank among pieces of their length, which is
counted in parts, so that a length that very many pieces share is dealt to many tasks.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import empty_text, give_back, partitions, ready, slices, written

CAPACITY = 4096
END_ID = 1
#: Distinct words, and ids of them, that a worker remembers before it starts anew.
WORDS, WORD_IDS = 800_000, 6_500_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Words:
    """Ids of words, each encoded once. The tokenizer drops white space and splits there, so words are independent."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.last[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def learn(self, new: list[bytes]) -> None:
        if len(self.index) > WORDS or self.used > WORD_IDS:
            self.clear()
        plain = [w for w in new if _LETTERS(w)]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            ids = np.array(self._ids([b" ".join(part)])[0], np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            # Letters alone are one pre-token, letters and stops two; each has one token with the mark of a word's end.
            runs = np.cumsum([1 + (w[-1] in _STOPS) for w in part])
            if len(ends) == runs[-1]:
                self._keep(part, ids, np.diff(ends[runs - 1], prepend=0))
        left = [w for w in new if w not in self.index]
        if left:
            ids = self._ids(left)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(left, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _keep(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.index), self.used
        self.starts, self.sizes = (_room(x, n + len(words)) for x in (self.starts, self.sizes))
        self.flat = _room(self.flat, m + len(flat))
        self.flat[m : m + len(flat)] = flat
        self.sizes[n : n + len(words)] = sizes
        self.starts[n : n + len(words)] = m + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of the texts in it."""
        split = [_split(t) for t in texts]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(at < 0)
        if len(missed):
            before = self.index
            self.learn(list(dict.fromkeys(words[i] for i in missed)))
            if self.index is not before:  # the memory began anew, so the places found are void
                self.learn([w for w in dict.fromkeys(words) if w not in self.index])
                missed = np.arange(len(words))
            at[missed] = np.fromiter((self.index[words[i]] for i in missed), np.int64, len(missed))
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)]


#: Words of composed lower-case Latin letters, with stops behind them or not, are encoded so many together.
_STOPS = b".,;:!?"
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+[.,;:!?]*").fullmatch
TOGETHER = 256


def _split(text: bytes) -> list[bytes]:
    """Words, lower-cased in ASCII as the tokenizer does. A text that may have special strings is only split."""
    return (text if b"<|" in text else text.lower()).split()


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        give_back()
        words = _words(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = words.encode(part.column("text").cast(pa.binary()).to_pylist())
                doc, piece, start, length, crc = [], [], [], [], []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        one = own[at : at + capacity]
                        doc.append(doc_id), piece.append(k), start.append(at), length.append(len(one)), crc.append(zlib.crc32(one.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and then end_id, cut where they pass the capacity.

    `tokenizer` is a .json file whose pre-tokenizer drops white space. A null text counts as empty: end_id alone.
    """
    ready(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))
    return given.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: rows (length, first rank, pieces, first sequence, pieces in a sequence, offset).

    Lengths above a third of the capacity: the longest is paired with the longest that still fits, so at most two are in
    a sequence. The others, longest first, go to the smallest gap that holds them; bins with one gap are one group.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    ranks = dict.fromkeys(counts, 0)
    groups: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    sequences = 0

    def put(length: int, bins: int, each: int, first: int, offset: int) -> None:
        out.append((length, ranks[length], bins * each, first, each, offset))
        ranks[length] += bins * each

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in groups:
                groups[gap] = []
                bisect.insort(gaps, gap)
            groups[gap].append((first, bins))

    large = sorted(x for x, n in counts.items() if 3 * x > capacity and n)
    left = {x: counts[x] for x in large}
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k == len(large) - 1 and left[a] == 1:
            k -= 1
        if k < 0:
            bins, b = left[a], 0
        else:
            b = large[k]
            bins = left[a] // 2 if a == b else min(left[a], left[b])
        put(a, bins, 1, sequences, 0)
        left[a] -= bins
        if b:
            put(b, bins, 1, sequences, a)
            left[b] -= bins
        leave(capacity - a - b, sequences, bins)
        sequences += bins
        for x in {a, b}:
            if b + a and x and not left[x]:
                large.remove(x)
    for length in sorted((x for x, n in counts.items() if 3 * x <= capacity and n), reverse=True):
        n = counts[length]
        while n:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                gap, first, bins = capacity, sequences, max(1, n // (capacity // length))
                sequences += bins
            else:
                gap = gaps[k]
                first, bins = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(k)
            each = min(gap // length, n)
            used = min(bins, n // each)
            put(length, used, each, first, capacity - gap)
            leave(gap - each * length, first, used)
            leave(gap, first + used, bins - used)
            n -= used * each
    return out


def _places(table):
    def run(batches):
        length, first, _, sequence, each, offset = table.value
        key = length * (1 << 40) + first
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, size * (1 << 40) + rank, side="right") - 1
            k = rank - first[at]
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence[at] + k // each[at]), pa.array(offset[at] + k % each[at] * size)], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: gapless from 0 in each sequence.

    Every piece gets a place, also those that repeat or have a null id. No pieces give no rows.
    """
    spark = parts.sparkSession
    n = partitions(spark)
    parts = written(parts.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int")))
    dealt = parts.groupBy("length", "deal").count()
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    rows = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    table = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(rows[:, i]) for i in range(6)))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.select("length", "deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "deal"]).withColumn("rank", F.col("base") + F.col("own"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_places(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in as few sequences of at most `capacity` tokens as best fit finds; see pieces() and pack()."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
