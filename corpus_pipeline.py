"""The corpus pipeline: documents without toxic ones, repeated lines and near copies, mixed by source and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import line_dedup, mixing, packing, simhash_dedup, toxicity
from docloom.llm.common import Scratch, cleared, table
from docloom.llm.queries import tokenizer_file


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below one half."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document with a smaller doc_id holds."""
    return line_dedup.drop_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return simhash_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean_toxicity),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("mix_sources", mix_sources),
    ("packing", pack_windows),
]
#: The first and last stages learn and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read back for the next. What a
    stage leaves there goes once its result is written, and that result once the next one's is."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with cleared():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
