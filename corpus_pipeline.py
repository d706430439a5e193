"""From raw documents to packed sequences, in five stages. Each reads what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import langid, near_dup, packing, pii, toxicity
from spanloom.llm.common import removed, table, written
from spanloom.llm.registry import tokenizer_path

#: Documents whose five-word shingle sets are at least so similar, in per cent, are near copies.
NEAR_PERCENT = 80
#: A language prediction below this is a rejection: such a text is like none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.4


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    A null text is scored as the empty one. Without labels of both kinds every score is 0 and every document stays; no
    documents give none. Rows that share an id are scored one by one; labels of null ids teach nothing.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into="__toxicity").where(F.col("__toxicity") < toxicity.THRESHOLD).select(*_columns(docs))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language that the model recognises.

    Null texts and texts without a letter are in no language and go. Where no document has both a language and a letter,
    there is nothing to recognise and every document stays; no documents give none. Rows that repeat are judged alike.
    """
    model = langid.fit(docs)
    if model is None:
        return docs
    found = langid.predict(docs, model, lang_into="__lang", score_into="__score")
    return found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; of rows that share an id, one.

    Null and empty texts are near nothing and stay; so does every row of a null id. No documents give none.
    """
    kept = near_dup.near_duplicates(docs, percent=NEAR_PERCENT).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("__r", F.row_number().over(one)).where("__r = 1").select(*_columns(docs))
    return named.unionByName(docs.where("doc_id IS NULL"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars, where there is one, is counted anew.

    Null texts stay null and keep their n_chars. Every row stays, also repeated ones and those of a null id.
    """
    found = pii.masked(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; a null text is an empty one, a piece of one id."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_dup", drop_near_duplicates), ("pii", mask_pii), ("packing", pack)]

#: SQL can express neither the two classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; what a stage wrote is removed once the next one has read it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if i:
            removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
