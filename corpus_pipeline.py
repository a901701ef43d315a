"""Five stages that turn ``documents`` into token ids.

Each stage takes (spark, docs, sf_dir), where docs has the columns of
``documents``, and returns what it keeps; all but the last return these columns
again.  A stage's result is written as Parquet before the next one reads it.

All stages take null in any column, empty and very long texts, repeated rows and
an empty table.  Columns beside those of ``documents``, whatever their names,
are left behind by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, language, mixing, neardup, substrings
from corpusloom.llm.shared import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a missing lang is filled in.

    Null texts, empty ones and those without a letter go, and all where no row
    has a lang to learn from.  Of equally likely languages the first by name counts.
    """
    found = language.identify(docs, language.learn(docs))
    return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the smallest id; rows without an id stay."""
    return neardup.deduplicated(docs).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller id has; documents of which nothing is left go.

    Texts that lose nothing stay as they are, to the character; rows without an id stay whole.
    """
    out = substrings.dedup(docs, with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to flattened shares of source, language and topic; missing values are a group of their own."""
    return mixing.sampled(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the digests of ids and of the decoded text; a null text has no ids."""
    return bpe.roundtrip(docs, with_ids=True).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL cannot express most stages; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
