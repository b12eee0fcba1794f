"""Corpus preparation in five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of documents. Null texts, and texts without a letter, go in the first
stage; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import byte_bpe, decontaminate, language_id, ngram_join, pii
from leafwork.llm.queries import table, vocabulary
from leafwork.llm.storage import dropped, saved


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: those that language identification calls ``und``."""
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    told = language_id.predict(docs, profiles)
    rejected = F.col("lang_pred") == "und"
    # Without a labelled row nothing is learnt, and texts with letters aren't rejected for that.
    return told.where(~rejected if profiles else F.col("text").rlike(r"\p{L}")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id."""
    return ngram_join.drop_copies(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars follows."""
    masked = pii.mask_text(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their number, and whether they decode to the text."""
    return byte_bpe.tokenize(docs, vocabulary())


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmarks),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]
#: Neither the language model nor BPE is SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage{k + 1}")
            dropped(before)  # the stage before that is read no more
            before = docs
    return docs
