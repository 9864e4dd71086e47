"""Five stages from raw documents to packed sequences; each result is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import decontaminate, ngram_join, packing, secrets, toxicity
from ledgerflow.llm.common import keep, read_table
from ledgerflow.llm.queries import WORD_TOKENIZER


#: Chunks that packing's workers remember: fewer than by itself, as the other stages use the same executors.
REMEMBERED = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded toxic go. The model learns from all labelled documents at hand."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return ngram_join.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER), remembered=REMEMBERED, across_tasks=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Models, suffix arrays and tokenizers can't be written in SQL; tests/llm holds the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return keep(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
