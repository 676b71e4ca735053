"""Clusters of models that keep coming: each new model gets the cluster of the first model identical to it.

Identity is equality of canonical forms, so the stream is keyed by the form and the state of a form is the name of the model
that came first. State outlives the run in the stream's checkpoint; a batch that is run again finds the state from before
it, and so gives the same clusters. A model whose form takes more than the budget is a cluster of its own and marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stoichion.functions.columns import STRONG
from stoichion.operators.cluster import BUDGET, canonical_forms
from stoichion.streaming.incremental import networks_stream

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfForm(StatefulProcessor):
    """Remembers the first model of a form; rows are passed on one by one, however many a batch has of one form."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "network string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        first = self.first.get()[0] if self.first.exists() else None
        for row in rows:
            new = first is None
            if new:
                first = row["network"]
                self.first.update((first,))
            yield Row(network=row["network"], cluster=first, is_new=new, is_indeterminate=row["is_indeterminate"])

    def close(self) -> None:
        pass


def clustered(networks: DataFrame, identity: str = STRONG, budget: int = BUDGET) -> DataFrame:
    """(network, cluster, is_new, is_indeterminate) of a stream of networks in rows."""
    forms = canonical_forms(networks, identity, budget).select("network", F.sha2("form", 256).alias("key"), "is_indeterminate")
    schema = "network string, cluster string, is_new boolean, is_indeterminate boolean"
    return forms.groupBy("key").transformWithState(FirstOfForm(), schema, "Append", "None")


def cluster_stream(spark: SparkSession, path: str, out: str, checkpoint: str, identity: str = STRONG, budget: int = BUDGET) -> StreamingQuery:
    """Appends the clusters of the JSON lines that appear at path to out."""
    spark.conf.set(_PROVIDER, _ROCKS)
    found = clustered(networks_stream(spark, path), identity, budget)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
