"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Defined results, in every stage: all columns of documents pass, whatever their names, and a column of n_chars follows the text
where there is one; a null text counts as empty, a null doc_id is an id like any other, a null host is the host ""; repeated rows are
judged alike; texts of any length are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoichion.llm import bagminhash, decontamination, line_rules, secret_scan
from stoichion.llm.keys import saved, workspace
from stoichion.llm.queries import bpe_digest

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """docs in the columns of before, n_chars following the text where there is such a column."""
    docs = docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)) if "n_chars" in before.columns else docs
    return docs.select(*(f"`{c}`" for c in before.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are too frequent at their host.

    Empty and null texts fail the rules and go; limits are strict, so that ties stay; plain copies count once.
    """
    return _counted(line_rules.clean(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the least doc_id.

    Of several rows with that id one stays; texts without words are alike only to equal ones; a null text is a class of its own.
    """
    return bagminhash.deduplicate(docs).select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a window of the benchmark.

    Items of fewer words than a window are one; null and empty items have none, null and empty texts hold none.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked.

    Where secrets overlap they get one mask, in the order in which they begin; null texts stay null.
    """
    return _counted(secret_scan.redact(docs), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of what they decode to, a row for each row; no tokens for null and empty texts.
    """
    return bpe_digest(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("byte_bpe", tokenize),
]

#: Signatures and token merges are beyond SQL; tests hold run() against documents listed by hand, not yet against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between two stages is written to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, folder, f"{i}-{name}")
    return docs
