"""Row identity and shared folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_key(text: str | Column = "text") -> Column:
    """16 bytes that stand for a text (null for null): rows of equal text share it on every executor and rerun."""
    return F.unhex(F.md5(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")))


def packed(df: DataFrame, but: str | None = None) -> Column:
    """All columns of df but one as a struct, beside which an operator's own columns can't clash with any of them."""
    names = [c for c in df.columns if c != but]
    return F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(0).alias("none"))


def field(name: str, row: str = "row") -> Column:
    """A column out of packed()."""
    return F.col(row).getField(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all runs in one process on
    one machine, a local one; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/stoichion-shared"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, outlives executors, computed once."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
