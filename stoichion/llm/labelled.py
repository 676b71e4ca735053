"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def in_fold(doc_id: str, folds: int, remainder: int) -> Column:
    """Whether an id falls into a fold; a null id, which no label can meet, into none."""
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def known(labels: DataFrame, label: str, allowed: Column, doc_id: str = "doc_id") -> DataFrame:
    """(_id, label) of the labelled documents that are allowed; of several labels of one the greatest counts."""
    return labels.where(allowed & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))


def sample(docs: DataFrame, picked: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of the documents picked (_id, label), a bounded number of rows, so that they may be broadcast;
    of several documents with one id any one is taken.
    """
    met = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "_id")
    return met.dropDuplicates(["_id"]).select("text", "label")


def pick(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows of known(), by a hash of their ids."""
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(n)
