"""The corpus pipeline: quality rules, exact and near de-duplication, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobledger.llm import exact, mixing, packing, quality, simhash
from jobledger.llm.common import read
from jobledger.llm.queries import TOKENIZER
from jobledger.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed limits nor the learned decision list reject."""
    rules = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, rules)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mixture; sources below their target weight start again, so their rows repeat."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document and its place; a repeated document has pieces of its own."""
    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("exact_copies", exact_copies), ("near_copies", near_copies),
    ("mixture", mixture), ("packed", packed),
]

# Learned rules, fingerprints and a genetic algorithm have no SQL form; tests/llm checks the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
