"""Toxicity by compression distance: windows of a text are compressed with an ordinary and a toxic zstandard dictionary.

The ordinary dictionary is trained on windows of ordinary documents. The toxic one is trained on the words of toxic
documents that toxic text uses far more often than ordinary text does, counted once for each distinct context, so that
copied documents and shared passages don't teach it. The toxic compressor has both. A second ordinary part holds
windows of ordinary text that the toxic part had made too short, found in a few rounds. A window's gain is the bytes
that the toxic dictionary saves; a logistic function calibrated on labelled documents turns a document's gains into a
score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import added, empty_text, first_by_hash, give_back, in_one_task, ready, slices
from spanloom.llm.near_dup import _PLACE, _mix, _words

#: Labelled documents that the fit sees at most: the first by a hash of their ids. Of a longer text it sees about so many
#: characters, in stretches spread evenly over the whole of it.
TOXIC_ROWS, ORDINARY_ROWS, ROW_CHARS, STRETCHES = 2000, 6000, 50_000, 25
WINDOW_WORDS = 16
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 16384, 4096, 1536
SEGMENT, SHINGLE = 16, 6
ENRICHED, CONTEXTS, ROUNDS = 6.0, 6, 3
THRESHOLD = 0.7
#: Stops and signs that end words in the toxic dictionary's samples.
_TO_BLANK = bytes.maketrans(b".,;:!?|*%#\"'()", b" " * 14)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


def _compressor(content: bytes):
    import zstandard as zs

    if len(content) < 8:
        content = b" " * 8 + content
    words = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    # Optimal parsing: windows are short, so a lazy parser's slips can hide what one word of the dictionary saves.
    how = zs.ZstdCompressionParameters.from_level(5, window_log=16, min_match=3, strategy=zs.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
    words.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=words, compression_params=how)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; of too few samples, these themselves."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size + 2048, samples, k=SEGMENT, d=SHINGLE).as_bytes()[-size:]
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def windows(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased in ASCII, some at a time; a text without words has one empty window."""
    words = text.lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, max(1, len(words)), WINDOW_WORDS)]


def _sizes(compressor, parts: list[bytes]) -> np.ndarray:
    import zstandard as zs

    if not parts:
        return np.zeros(0, np.int64)
    length = np.fromiter(map(len, parts), np.uint64, len(parts))
    at = np.cumsum(length) - length
    out = compressor.multi_compress_to_buffer(zs.BufferWithSegments(b"".join(parts), np.stack([at, length], 1).astype("<u8").tobytes()), threads=0)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


class _Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(ordinary + toxic)

    def gains(self, parts: list[bytes]) -> np.ndarray:
        return _sizes(self.ordinary, parts) - _sizes(self.toxic, parts)

    def features(self, texts: list[bytes], known: dict[bytes, int] | None = None) -> np.ndarray:
        """Features of each text; `known` has gains of windows that were found before."""
        split = [windows(t) for t in texts]
        each = [w for x in split for w in x]
        if known:
            new = [w for w in dict.fromkeys(each) if w not in known]
            known.update(zip(new, self.gains(new).tolist(), strict=True))
            gain = np.array([known[w] for w in each], float)
        else:
            gain = self.gains(each).astype(float)
        out, at = np.zeros((len(texts), 13)), 0
        for row, x in zip(out, split, strict=True):
            g = np.sort(gain[at : at + len(x)])[::-1]
            at += len(x)
            over = [int((g >= t).sum()) for t in (3, 4, 5, 6, 7)]
            top = np.pad(g[:3], (0, max(0, 3 - len(g))))
            row[:] = [*top, g.mean(), np.log(len(g)), over[0] / len(g), over[2] / len(g), over[1] > 0, over[2] > 0, over[3] > 0, *np.log1p([over[1], over[2], over[4]])]
        return out


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and how many distinct (word before, word, word after) each has; then, of the first occurrence of
    each such context, the hash and its place among all words. Numbers only: the texts are gone over in small parts.
    """
    hashes, keys = [], []
    with np.errstate(over="ignore"):
        for at in range(0, len(texts), 256):
            part = [_plain(t) for t in texts[at : at + 256]]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in part])])
            h, begin = _words(np.frombuffer(b"".join(part), np.uint8), ends)
            owner = np.searchsorted(ends, begin, side="right")
            same = np.append(False, owner[1:] == owner[:-1])[: len(h)]
            before = np.where(same, np.append(np.uint64(0), h[:-1])[: len(h)], np.uint64(0))
            after = np.where(np.append(same[1:], False)[: len(h)], np.append(h[1:], np.uint64(0))[: len(h)], np.uint64(0))
            hashes.append(h)
            keys.append(_mix(before * _PLACE[0] + h * _PLACE[1] + after * _PLACE[2]))
    h, k = np.concatenate(hashes), np.concatenate(keys)
    first = np.zeros(len(k), dtype=bool)
    first[np.unique(k, return_index=True)[1]] = True
    word, count = np.unique(h[first], return_counts=True)
    return word, count, h, first


def _plain(text: bytes) -> bytes:
    return text.lower().translate(_TO_BLANK) + b" "


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[bytes], ordinary: list[bytes], share: float | None = None) -> Model | None:
    """A model from toxic and ordinary texts; share: of toxic ones among labelled documents, if the lists have another.

    Every second distinct window of the ordinary texts teaches the base dictionary; the others, which it has not seen, find
    the windows that it compresses badly, and these the second one.
    """
    if not toxic or not ordinary:
        return None
    bad, n_in_bad, told, fresh = _contexts(toxic)
    good, n_in_good, _, _ = _contexts(ordinary)
    at = np.minimum(np.searchsorted(good, bad), max(0, len(good) - 1))
    elsewhere = np.where(good[at] == bad, n_in_good[at], 0) if len(good) else np.zeros(len(bad))
    n_bad, n_good = max(1, int(n_in_bad.sum())), max(1, int(n_in_good.sum()))
    telling = bad[(n_in_bad >= CONTEXTS) & ((elsewhere + 0.5) * n_bad * ENRICHED < n_in_bad * n_good)]
    chosen = np.isin(told, telling) & fresh
    words, k = [], 0
    for t in toxic:
        split = _plain(t).split()
        own = dict.fromkeys(w for w, c in zip(split, chosen[k : k + len(split)], strict=True) if c)
        k += len(split)
        if own:
            words.append(b" " + b" ".join(own) + b" ")
    toxic_part = _dictionary(words, TOXIC_BYTES) if words else b""
    plain = list(dict.fromkeys(w for t in ordinary for w in windows(t)))
    base, hard = _dictionary(plain[::2], ORDINARY_BYTES), []
    for _ in range(ROUNDS):
        front = _dictionary(hard, HARD_BYTES) if len(hard) > 100 else b""
        scorer = _Scorer(front + base, toxic_part)
        gain = scorer.gains(plain)
        hard = list(dict.fromkeys([*hard, *(w for w, g in zip(plain, gain, strict=True) if g >= 3)]))
    known = dict(zip(plain, gain.tolist(), strict=True))
    x = np.concatenate([scorer.features(part[i : i + 256], known) for part in (ordinary, toxic) for i in range(0, len(part), 256)])
    y = np.concatenate([np.zeros(len(ordinary)), np.ones(len(toxic))])
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic(np.c_[(x - centre) / spread, np.ones(len(x))], y)
    if share is not None and 0 < share < 1:
        here = len(toxic) / len(y)
        w[-1] += np.log(share / (1 - share)) - np.log(here / (1 - here))
    return Model(front + base, toxic_part, w, centre, spread)


def held_out(id_col: str | Column) -> Column:
    return F.crc32(F.col(id_col) if isinstance(id_col, str) else id_col) % 3 == 1


def excerpt(text: Column) -> Column:
    """A text of up to ROW_CHARS characters, or STRETCHES stretches of equal length spread evenly over a longer one."""
    size = ROW_CHARS // STRETCHES
    step = (F.length(text) - size) / (STRETCHES - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substr(text, F.floor(k * step).cast("int") + 1, F.lit(size)))
    return F.when(text.isNull() | (F.length(text) <= ROW_CHARS), text).otherwise(F.array_join(parts, " "))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from labelled documents that are not held out; None if there are not both kinds.

    Labels join by id; null ids, labels and texts teach nothing; of rows that share an id one text is seen, the least.
    At most TOXIC_ROWS + ORDINARY_ROWS documents, each cut by excerpt(), meet in one task, which trains; only the model
    comes to the driver. The share of toxic ones is counted over all labels.
    """
    ready(docs.sparkSession)
    learn = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col).cast("string").cast("binary")))
    learn = learn.groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("__y"))
    count = {r["__y"]: r["count"] for r in learn.groupBy("__y").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    ids = None
    for y, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        some = first_by_hash(learn.where(F.col("__y") == y), "__id", most, count.get(y, 0))
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    rows = texts.join(F.broadcast(ids), "__id").select("__id", "__y", excerpt(F.col("__t")).alias("__t"))
    rows = rows.groupBy("__id", "__y").agg(F.min("__t").alias("__t"))

    def make(given: pa.Table) -> Model | None:
        given = given.sort_by([("__id", "ascending")])
        y, t = given.column("__y").to_numpy(), [x.encode() for x in given.column("__t").to_pylist()]
        return train([x for x, k in zip(t, y, strict=True) if k == 1], [x for x, k in zip(t, y, strict=True) if k == 0], share)

    return in_one_task(rows, make)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with one more column `into` from 0 to 1, from the whole text alone; null counts as the empty text.

    Without a model every score is 0. A column named `into` that docs already has is replaced.
    """
    spark = ready(docs.sparkSession)
    kept = [c for c in docs.columns if c != into]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(into))
    sent = spark.sparkContext.broadcast(model)  # some 25 KB

    def run(batches):
        give_back()
        m = sent.value
        scorer = _Scorer(m.ordinary, m.toxic)
        for batch in batches:
            for part in slices(batch, "__text"):
                x = (scorer.features([t.encode() for t in part.column("__text").to_pylist()]) - m.centre) / m.spread
                z = np.c_[x, np.ones(len(x))] @ m.weights
                yield [*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]

    return added(docs, kept, empty_text(f"`{text_col}`"), [(into, "double")], run)
