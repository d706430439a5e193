"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into a fixed number of features. Document frequencies are counted over all
documents to learn from; the weights are trained with follow-the-regularised-leader (FTRL-proximal, an elastic net) on a
bounded sample of them, and a temperature, fitted on a part of it set aside, calibrates the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import added, empty_text, give_back, in_one_task, ready, slices

FEATURES = 1 << 14
#: Rows that the weights are trained on, at most: of each language, of all together, and yet so many of each language.
ROWS_PER_LANGUAGE, ROWS, LEAST_ROWS = 1500, 96_000, 50
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.5, 0.1, 3
UNKNOWN = "und"
STRETCH = 1 << 20


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    first: np.ndarray  # of each feature, where its weights begin in the next two; and the end
    classes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores of all languages, from the weights that are not 0."""
        size = self.first[at + 1] - self.first[at]
        end = np.cumsum(size)
        k = np.arange(end[-1]) + np.repeat(self.first[at] - end + size, size)
        return np.bincount(self.classes[k], self.weights[k] * np.repeat(x, size), len(self.bias)) + self.bias


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    import sys

    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def counts(text: str) -> np.ndarray | None:
    """How often each feature occurs in a text; None if it has no letter. Other than letters count as one space."""
    total = None
    for at in range(0, len(text), STRETCH):
        c = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        if not letter.any():
            continue
        c = np.where(letter, c, 32).astype(np.uint64)
        gap = c == 32
        keep = ~(gap & np.append(False, gap[:-1]))
        c = np.concatenate([[np.uint64(32)], c[keep], [np.uint64(32)]])
        with np.errstate(over="ignore"):
            one = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            two = (one[:-1] ^ (c[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xBF58476D1CE4E5B9)
            three = (two[:-1] ^ (c[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0x94D049BB133111EB)
        h = np.concatenate([one[c != 32], two, three]) >> np.uint64(64 - 14)
        part = np.bincount(h.astype(np.int64), minlength=FEATURES)
        total = part if total is None else total + part
    return total


def _weighed(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(count)
    x = np.log1p(count[at]) * idf[at]
    return at, x / max(1e-12, np.sqrt((x * x).sum()))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _document_frequencies(batches):
    df, n, rows = np.zeros(FEATURES, np.int64), 0, Counter()
    for batch in batches:
        rows.update(batch.column("lang").to_pylist())
        for text in batch.column("text").to_pylist():
            c = counts(text)
            if c is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int32()), pa.nulls(len(at) + 1, pa.string()), pa.array(np.append(n, df[at]))], ["feature", "lang", "n"])
    yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int32()), pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], ["feature", "lang", "n"])


def _rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            found = [(lang, counts(t)) for lang, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True)]
            found = [(lang, np.flatnonzero(c), c) for lang, c in found if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.int32())), pa.array([x[2][x[1]] for x in found], pa.list_(pa.int32()))], ["lang", "at", "n"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by classes) and biases. The L1 part keeps a weight at 0 until its gradients add up to enough."""
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], FEATURES), np.append(rows[i][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    best, at = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.05), np.log(5), 60)):
        s = logits / t
        loss = (np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(y)), y]).mean()
        if loss < best - 1e-12:
            best, at = loss, float(t)
    return at


def train(rows: pa.Table, idf: np.ndarray) -> Model:
    """A model from rows (lang, at, n): the features of a text and their counts. Every tenth row calibrates."""
    rows = rows.combine_chunks()
    lang, size = np.array(rows.column("lang").to_pylist()), pc.list_value_length(rows.column("at")).to_numpy()
    marks = np.array([zlib.crc32(at.values.to_numpy().tobytes()) for at in rows.column("at")])
    rows = rows.take(np.lexsort((marks, size, lang)))
    languages, y = np.unique(np.sort(lang), return_inverse=True)
    x = []
    for at, c in zip(rows.column("at"), rows.column("n"), strict=True):
        full = np.zeros(FEATURES)
        full[at.values.to_numpy()] = c.values.to_numpy()
        x.append(_weighed(full, idf))
    aside = (np.arange(len(x)) % 10 == 9) & (np.diff(y, prepend=-1) == 0)  # not a language's first row: it may be its only one
    aside = aside if aside.any() else ~aside
    taught = [i for i in range(len(x)) if not aside[i]] or list(range(len(x)))
    w, b = ftrl([x[i] for i in taught], y[taught], len(languages))
    w = w.astype(np.float32)
    model = Model(languages.tolist(), idf, np.append(0, np.cumsum((w != 0).sum(axis=1))), np.nonzero(w)[1].astype(np.int32), w[w != 0], b, 1.0)
    model.temperature = _temperature(np.array([model.logits(*x[i]) for i in np.flatnonzero(aside)]), y[aside])
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from documents with a language that are not held out; None if none has a letter.

    Only text and language are looked at. Document frequencies cover all of these documents, and every language is
    learned; weights are trained on the first distinct rows (id and text) of each language by a hash, ROWS_PER_LANGUAGE or
    an equal share of ROWS, but LEAST_ROWS at least; they meet in one task, and only the model comes to the driver. Rows
    that repeat teach once.
    """
    spark = ready(docs.sparkSession)
    learn = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    learn = learn.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # At most FEATURES + 1 rows, and one for each language.
    found = learn.select("lang", "text").mapInArrow(_document_frequencies, "feature int, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n")).toArrow()
    told = found.filter(pc.is_valid(found.column("feature")))
    rows = {r["lang"]: r["n"] for r in found.filter(pc.is_valid(found.column("lang"))).to_pylist()}
    if not told.num_rows:
        return None
    n = np.zeros(FEATURES + 1, np.int64)
    n[told.column("feature").to_numpy()] = told.column("n").to_numpy()  # place -1 has the documents
    idf = np.log((1 + n[-1]) / (1 + n[:-1])) + 1
    most = min(ROWS_PER_LANGUAGE, max(LEAST_ROWS, ROWS // len(rows)))
    # A bound on a hash, wide enough for three times as many distinct rows, comes first, so no task gets all rows of a
    # language; what repeats within it is one row before it is ranked.
    learn = learn.withColumn("mark", F.xxhash64("id", "text"))
    distinct = {r["lang"]: r["count"] for r in learn.select("lang", "mark").distinct().groupBy("lang").count().collect()}
    bounds = spark.createDataFrame([(lang, min(1 << 32, (3 * most << 32) // r)) for lang, r in distinct.items()], "lang string, bound long")
    near = learn.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(1 << 32)) < F.col("bound"))
    once = near.groupBy("lang", "mark", "id").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    chosen = once.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    return in_one_task(chosen.select("lang", "text").mapInArrow(_rows, "lang string, at array<int>, n array<int>"), lambda given: train(given, idf))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_into: str = "lang_pred", score_into: str = "lang_score") -> DataFrame:
    """docs with the likeliest learned language of each whole text, and its probability.

    A text that is null or has no letter, and any text without a model, gets `und` and 0. Columns of these two names that
    docs already has are replaced; language, source and id are not looked at.
    """
    spark = ready(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (lang_into, score_into)]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(UNKNOWN).alias(lang_into), F.lit(0.0).alias(score_into))
    sent = spark.sparkContext.broadcast(model)  # the weights that are not 0

    def run(batches):
        give_back()
        m = sent.value
        for batch in batches:
            lang, score = [], []
            for text in batch.column("__text").to_pylist():
                c = counts(text)
                if c is None:
                    lang.append(UNKNOWN), score.append(0.0)
                    continue
                at, x = _weighed(c, m.idf)
                s = m.logits(at, x) / m.temperature
                p = np.exp(s - s.max())
                lang.append(m.languages[int(p.argmax())]), score.append(float(p.max() / p.sum()))
            yield [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return added(docs, kept, empty_text(f"`{text_col}`"), [(lang_into, "string"), (score_into, "double")], run)
