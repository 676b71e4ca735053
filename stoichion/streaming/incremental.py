"""Models that keep coming: JSON lines of a folder, matched against fixed references as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stoichion.functions.columns import STRONG
from stoichion.operators.search import mapping_counts
from stoichion.sources.files import from_json


def networks_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Networks in rows from the files that appear at path."""
    return from_json(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def match_stream(spark: SparkSession, path: str, references: DataFrame, out: str, checkpoint: str, identity: str = STRONG, budget: int | None = None) -> StreamingQuery:
    """Appends the mapping counts of each batch of new networks to out, in a folder of the batch, so that a batch that
    runs again replaces its own rows.
    """

    def handle(batch: DataFrame, number: int) -> None:
        mapping_counts(references, batch, identity, budget=budget).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return networks_stream(spark, path).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
