"""The corpus pipeline: stages over documents, each written and read again by its runner.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents.

Defined results, for every stage: a null text counts as empty; rows without an id
are documents like others; rows that repeat an id are told apart by their text;
an empty table gives an empty result; other columns pass through untouched, under
whatever names.  The operators' docstrings say what else.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, near_dup, packing, pii, quality_fm
from tidewater.llm.common import discard, materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, doesn't reject."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; where none has an id, all of them stay for the next stage."""
    return exact_dedup.keep_one(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8 or more, linked) the row with the smallest id, before rows without one."""
    return near_dup.one_of_each(docs, n=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it replaced; n_chars, where there is one, follows the text."""
    clean = pii.sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.with_crc(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), slice_bytes=2 << 20, wide=True))  # workers still hold what earlier stages loaded


STAGES = [
    ("quality", good_quality),
    ("exact duplicates", distinct_texts),
    ("near duplicates", distinct_content),
    ("personal data", without_personal_data),
    ("packing", packed),
]

# training, similarity over components and packing aren't SQL: tests/llm holds the stages and run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
