"""A training-data pipeline over ``documents``: five stages, each one operator of ``hopweave.llm``.

Toxic documents go, boilerplate lines are cut, one document of each near-duplicate group stays (shingles of five
words, similarity 0.8), documents that hold a benchmark item go, and what is left is encoded and decoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's rows as Parquet
into the shared folder and reads them again as the next stage's documents. All but the last return the columns of
``documents``, whatever else they are called. Null and empty texts pass every filter; rows that tie at a threshold
are treated as their operator says; rows that repeat both id and text are one near-duplicate group. Texts are taken
whole. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm import bpe, decontaminate, jaccard, lines, toxicity
from hopweave.llm.common import quoted, staged, table

#: The tokenizer's rank file and pattern.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled documents of the table; every document is scored."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = max(docs.columns, key=len) + "_lines"  # a name of its own
    cleaned = lines.without_boilerplate(docs, linked_copies=True, removed=removed)
    n = F.length("text").cast("long")
    return cleaned.select(*[F.when(F.col(quoted(removed)) > 0, n).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_near_duplicates(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs.select("doc_id", "text"), RANKS, PATTERN, ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_boilerplate),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", tokenize),
]

#: Trained scores, edit distances and merges by rank are not SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
