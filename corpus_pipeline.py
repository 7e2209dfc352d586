"""A training corpus in four stages: language identification, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. All but the last return the columns of documents, also those that it does not
know; the last one returns pieces of sequences.

Defined cases: a null text has no letter and goes in the first stage, as do texts without
letters. Rows with a null id are all kept; of near copies the row with the smallest id
stays, and of rows that repeat that id one. A document of which exactly a twentieth of
the words is a benchmark's goes. An empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import decontaminate, langid, minhash, packing
from dialoom.sources.scratch import Scratch


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: those without a letter, or unlike all languages seen."""
    return langid.drop_rejected(docs, langid.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages cover a twentieth or more."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, percent=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier and a tokenizer's vocabulary are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again as the next one's."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
