"""The corpus preparation pipeline: five operators, each on all that the one before it kept.

    toxicity        documents that the lexicon scores at its threshold or above go
    exact dedup     of equal texts (but for the case of A-Z) the smallest id stays
    near dedup      of documents that similarity links connect the smallest id stays
    decontaminate   documents that overlap a benchmark item go
    bpe             what is left becomes token ids

All stages but the last return rows of their input with its columns, whatever those are. Null texts
count as empty and stay but as copies of each other; null ids and ids that repeat are told apart by
their texts, rows that repeat in full are one. Very long texts are read whole by every stage. An empty
table gives an empty result; other columns are carried along and never looked at, but to decide
between rows that agree in id and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semindex.llm import bpe, decontaminate, exact_dedup, near_join, toxicity
from semindex.llm.common import discard, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(spark, sf_dir, docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, columns=("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"), block_chars=BLOCK_CHARS)


#: Smaller blocks than the operator's own take less memory and more disk, which is plentiful here.
BLOCK_CHARS = 6_000_000


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("bpe", tokenize),
]

#: A learned lexicon and a tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:  # what the stage has read is needed no more
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
