"""From raw documents to packed training sequences: quality, near copies, repeated passages, benchmark passages, packing.

In every stage rows with a null id pass unchanged until the last, which leaves them out; null texts count as empty; rows that repeat an id are
documents of their own; other columns pass, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm import decontaminate, kneser_ney, packing, runlength_index, trie_join
from pairforge.llm.common import discard, small_batches, written
from pairforge.llm.encoding import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject: texts without bytes and languages without trusted texts stay."""
    small_batches(spark)
    return kneser_ney.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id; null and empty texts are no copies."""
    return trie_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that occur elsewhere as well; texts left empty stay as empty ones, null texts as null."""
    return runlength_index.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; null and empty texts stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; an empty text is one piece of the end id."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("sequences", sequences),
]

#: SQL expresses none of the model, the components and the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row, each written to the shared folder and read by the next; what a stage has read goes once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return docs
