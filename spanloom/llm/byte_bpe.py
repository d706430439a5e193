"""Byte-level BPE by a local rank file: encoding to ids, and decoding ids to bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from spanloom.llm.common import added, empty_text, ready, slices
from spanloom.llm.units import stretches

#: Longer texts are encoded in parts of about so many characters, cut at safe boundaries.
STRETCH = 1 << 15
#: A run of the pattern's white space (Unicode's White_Space) that is taken out before matching.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The encoding of a rank file (a token in base64 and its rank in each line), without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, ranks_path: str, pattern: str) -> list[int]:
    """The ids of a text. A long run of white space is one piece, less its last character where more text follows,
    as the pattern cuts it; it is encoded as such, since matching it takes a stack as deep as the run is long.
    """
    enc = encoding(ranks_path, pattern)
    out: list[int] = []
    at = 0
    for run in _LONG_RUN.finditer(text):
        for part in stretches(text[at : run.start()], STRETCH):
            out += enc.encode_ordinary(part)
        at = run.end() - (run.end() < len(text))
        out += enc._encode_single_piece(text[run.start() : at])
    for part in stretches(text[at:], STRETCH):
        out += enc.encode_ordinary(part)
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """docs with one more column `into`: the ids of each whole text, array<int>. A null text counts as empty: no ids.

    A column named `into` that docs already has is replaced; other columns and rows pass through.
    """
    ready(docs.sparkSession)
    kept = [c for c in docs.columns if c != into]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                yield [*part.columns[:-1], pa.array([encode_text(t, ranks_path, pattern) for t in part.column("__text").to_pylist()], pa.list_(pa.int32()))]

    return added(docs, kept, empty_text(f"`{text_col}`"), [(into, ArrayType(IntegerType()))], run)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with one more binary column `into`: the bytes of the ids. Null ids give null, no ids no bytes."""
    ready(rows.sparkSession)
    kept = [c for c in rows.columns if c != into]

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            out = [None if x is None else enc.decode_bytes(x) for x in batch.column("__text").to_pylist()]
            yield [*batch.columns[:-1], pa.array(out, pa.binary())]

    return added(rows, kept, F.col(f"`{ids_col}`"), [(into, "binary")], run)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids, digest of the ids as decimal text, digest of the bytes they decode to.

    Ids go from encoding to decoding inside the task, so no ids are moved between processes.
    """
    ready(docs.sparkSession)

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                n, a, b = [], [], []
                for text in part.column("text").to_pylist():
                    ids = encode_text(text, ranks_path, pattern)
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
