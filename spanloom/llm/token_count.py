"""Token counts of documents: the pieces of each distinct pre-token are counted once, then joined and summed.

Pre-tokens are units (see units.py). The commonest ones, of bounded number, are looked up in a broadcast table; only the
rest is shuffled to its count. Long ones go by a digest instead of their text, in both, so none that is common is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from functools import lru_cache
from itertools import repeat
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import empty_text, ready, slices, written
from spanloom.llm.units import units

#: Pre-tokens in the broadcast table, and distinct ones that a task holds before it passes them on.
COMMON = 1 << 18
HELD = 300_000
#: Bytes of a pre-token that stands for itself, not by a digest, and characters of longer ones that a task holds before it passes them on.
SHORT = 63
HELD_LONG = 1 << 25


@lru_cache(maxsize=4)
def _json_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _specials(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f).get("added_tokens", []))


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _count(path: str, texts: list[str]) -> list[int]:
    """Pieces of each text, as the library for this kind of file gives them."""
    if path.endswith(".model"):
        return [len(x) for x in _model(path).encode(texts, num_threads=1)]
    return [len(x) for x in _json_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def pretokens(path: str, text: str) -> list[str]:
    """The pre-tokens of a text. A special string is one of its own, as the library takes it out before it splits.

    A sentence-piece model normalises across spaces, so there a whole text is one pre-token.
    """
    if path.endswith(".model"):
        return [text] if text else []
    found = [s for s in _specials(path) if s in text]
    if not found:
        return units(text)
    import re

    parts = re.split("(" + "|".join(re.escape(s) for s in sorted(found, key=len, reverse=True)) + ")", text)
    return [u for i, part in enumerate(parts) if part for u in ([part] if i % 2 else units(part))]


def key(unit: str) -> str:
    """A pre-token of at most SHORT bytes as it is; a longer one's digest, which has one byte more than SHORT."""
    if len(unit) * 4 <= SHORT or len(data := unit.encode()) <= SHORT:
        return unit
    return "#" + hashlib.blake2b(data, digest_size=(SHORT + 1) // 2).hexdigest()[:SHORT]


def _distinct(path: str):
    def run(batches):
        held: Counter = Counter()
        long = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["unit", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = pretokens(path, text)
                held.update(found)
                if max(map(len, found), default=0) > SHORT:
                    long += sum(len(u) for u in found if len(u) > SHORT)
                if long > HELD_LONG:
                    yield out()
                    held.clear()
                    long = 0
            if len(held) > HELD:
                yield out()
                held.clear()
                long = 0
        if held:
            yield out()

    return run


def _pieces(path: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "unit"):
                found = part.column("unit").to_pylist()
                n = _count(path, found)
                yield pa.RecordBatch.from_arrays([pa.array([key(u) for u in found], pa.string()), part.column("n"), pa.array(n, pa.int32())], ["unit", "n", "pieces"])

    return run


def _frequencies(path: str, common):
    def run(batches):
        known = common.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                ids, marks = part.column("doc_id").to_pylist(), part.column("mark").to_pylist()
                row, unit, freq, done, size = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    count = Counter(pretokens(path, text))
                    pieces = list(map(known.get, count, repeat(0)))  # 0 where the table has none
                    row.append(i), unit.append(None), freq.append(None), size.append(len(text.encode())), done.append(sum(map(mul, pieces, count.values())))
                    rare = [(key(u), f) for (u, f), n in zip(count.items(), pieces, strict=True) if not n]
                    if max((len(k) for k, _ in rare), default=0) > SHORT:  # a digest, which is common or not
                        done[-1] += sum(f * known.get(k, 0) for k, f in rare if len(k) > SHORT)
                        rare = [(k, f) for k, f in rare if len(k) <= SHORT or k not in known]
                    row += [i] * len(rare)
                    unit += [k for k, _ in rare]
                    freq += [f for _, f in rare]
                    done += [None] * len(rare)
                    size += [None] * len(rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in row], pa.int64()), pa.array([marks[i] for i in row], pa.int64()), pa.array(unit, pa.string()), pa.array(freq, pa.int32()), pa.array(done, pa.int64()), pa.array(size, pa.int64())],
                    ["doc_id", "mark", "unit", "f", "done", "n_bytes"],
                )

    return run


def _least_common(pieces: DataFrame) -> int:
    """The least count for which at most COMMON pre-tokens are as frequent, from a histogram of some hundred rows."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    found = pieces.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("units"), F.min("n").alias("least")).collect()
    least, units_ = 1 << 62, 0
    for r in sorted(found, key=lambda r: -r["size"]):
        units_ += r["units"]
        if units_ > COMMON:
            break
        least = r["least"]
    return least


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a .json file (tokenizers) or a .model file (sentencepiece) that every worker can read.
    Texts are taken whole; null counts as empty, with 0 tokens. Rows that repeat give as many equal rows; a null id is
    kept. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))
    pieces = written(texts.select("text").mapInArrow(_distinct(tokenizer), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).mapInArrow(_pieces(tokenizer), "unit string, n long, pieces int"))
    top = pieces.where(F.col("n") >= _least_common(pieces)).select("unit", "pieces").toArrow()
    common = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    rows = texts.withColumn("mark", F.xxhash64("text", F.octet_length("text"))).mapInArrow(_frequencies(tokenizer, common), "doc_id long, mark long, unit string, f int, done long, n_bytes long")
    # One row per document stays as it is; the rare pre-tokens find their counts. Both meet in one sum by document.
    heads = rows.where(F.col("unit").isNull()).select("doc_id", "mark", "done", "n_bytes", F.lit(1).alias("copies"))
    tails = rows.where(F.col("unit").isNotNull()).join(pieces.select("unit", "pieces"), "unit").select("doc_id", "mark", (F.col("pieces") * F.col("f")).cast("long").alias("done"), F.lit(None).cast("long").alias("n_bytes"), F.lit(0).alias("copies"))
    summed = heads.unionByName(tails).groupBy("doc_id", "mark").agg(F.sum("done").alias("done"), F.max("n_bytes").alias("n_bytes"), F.sum("copies").alias("copies"))
    # Rows with one id and one text were summed together.
    return (
        summed.withColumn("n_tokens", (F.col("done") / F.col("copies")).cast("long"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .drop("copy")
    )
