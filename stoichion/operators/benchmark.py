"""Benchmarks as tables: planted pairs searched, candidate counts by sets of features, curves of them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG, WEAK
from stoichion.model import from_nested
from stoichion.operators import compat
from stoichion.operators.features import REACTION, SPECIES, FeatureSpec, option_sets, short_name
from stoichion.operators.projection import edge_list_text
from stoichion.operators.random_networks import experiments
from stoichion.operators.search import Net, Search, mapping_pairs
from stoichion.store import saved, workspace


def population(spark: SparkSession, n: int, species: int, reactions: int, fill: int, identical: bool = True, seed: int = 0) -> DataFrame:
    """(id, reference, target, species_at, reactions_at): references with fill more species and reactions around them; without
    identical, references that a changed cell keeps from fitting.
    """
    return experiments(spark, n, species, reactions, fill, identical, seed)


def sides(planted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and targets of planted pairs, networks in rows; a pair's two have its number as name."""
    one = lambda c: planted.select(F.col("id").cast("string").alias("network"), f"{c}.species", f"{c}.reactions", f"{c}.cells")
    return one("reference"), one("target")


def export(planted: DataFrame, path: str, identity: str = STRONG) -> None:
    """Writes the edge lists of planted pairs as text, a folder for each network below reference and target, as graph tools read them."""
    for networks, side in zip(sides(planted), ("reference", "target"), strict=True):
        edge_list_text(from_nested(networks), identity).write.mode("overwrite").partitionBy("network").text(f"{path}/{side}")


def run(planted: DataFrame, identity: str = STRONG, budget: int | None = None) -> DataFrame:
    """(id, n_pairs, is_truncated, is_identical): each reference searched in its own target; is_identical says that the
    planted mapping is among those found.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                began = time.process_time()
                work = Search(Net.of(x["reference"], identity), Net.of(x["target"], identity), budget=budget)
                n, good = 0, False
                for species, reactions in work.pairs():
                    n += 1
                    good = good or (species == x["species_at"] and reactions == x["reactions_at"])
                rows.append((x["id"], n, work.truncated, good, time.process_time() - began))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["id", "n_pairs", "is_truncated", "is_identical", "seconds"])

    return planted.mapInArrow(search, "id long, n_pairs long, is_truncated boolean, is_identical boolean, seconds double")


def run_summary(results: DataFrame) -> DataFrame:
    """(n, n_success, n_truncated, seconds) of run()."""
    return results.agg(F.count("*").alias("n"), F.count_if("is_identical").alias("n_success"), F.count_if("is_truncated").alias("n_truncated"), F.sum("seconds").alias("seconds"))


def flagged(planted: DataFrame, results: DataFrame, flag: str) -> DataFrame:
    """The planted pairs whose result has is_identical or is_truncated."""
    if flag not in ("is_identical", "is_truncated"):
        raise ValueError(f"no flag {flag}")
    return planted.join(results.where(flag).select("id"), "id", "left_semi")


def candidate_table(planted: DataFrame, node: str, specs: list[FeatureSpec] | None = None, subset: bool = True, identity: str = WEAK) -> DataFrame:
    """(id, log10_n): log10 of the product of the candidate counts of a pair's nodes, null where a node has none."""
    refs, tgts = (from_nested(x).projected(identity) for x in sides(planted))
    found = compat.candidates(refs, tgts, node, specs, subset).where("reference = target")
    nodes = (refs.species.withColumnRenamed("species", "ref_node") if node == SPECIES else refs.reactions.withColumnRenamed("reaction", "ref_node")).withColumnRenamed("network", "reference")
    n = nodes.join(found.groupBy("reference", "ref_node").agg(F.count("*").alias("n")), ["reference", "ref_node"], "left").select("reference", F.coalesce("n", F.lit(0)).alias("n"))
    log = F.when(F.min("n") > 0, F.sum(F.log10(F.greatest("n", F.lit(1)).cast("double"))))
    return n.groupBy(F.col("reference").cast("long").alias("id")).agg(log.alias("log10_n"))


def compare(planted: DataFrame, nodes: tuple[str, ...] = (SPECIES, REACTION), subset: bool = True, identity: str = WEAK) -> DataFrame:
    """(node, option, id, log10_n) for every set of the default features of the given kinds of nodes."""
    folder = workspace(planted.sparkSession, "benchmark")
    planted = saved(planted, folder, "planted")
    parts = [candidate_table(planted, node, specs, subset, identity).select(F.lit(node).alias("node"), F.lit(short_name(specs)).alias("option"), "id", "log10_n") for node in nodes for specs in option_sets(node)]
    return reduce(DataFrame.unionByName, parts)


def curve(counts: DataFrame, by: list[str], value: str = "log10_n") -> DataFrame:
    """counts with share: how many of its group's values are not greater."""
    return counts.withColumn("share", F.cume_dist().over(Window.partitionBy(*by).orderBy(value)))


def planted_found(planted: DataFrame, found: DataFrame) -> DataFrame:
    """(id, is_found) of mapping_pairs() of all sides: whether the planted mapping stands among those of its pair."""
    own = found.where("reference = target").select(F.col("reference").cast("long").alias("id"), F.col("species").alias("species_at"), F.col("reactions").alias("reactions_at")).distinct()
    met = planted.select("id", "species_at", "reactions_at").join(own.withColumn("is_found", F.lit(True)), ["id", "species_at", "reactions_at"], "left")
    return met.select("id", F.coalesce("is_found", F.lit(False)).alias("is_found"))


def speed_up(spark: SparkSession, planted: DataFrame, parts: list[int], identity: str = STRONG) -> list[tuple[int, float]]:
    """(partitions, seconds) of the same search dealt to more and more partitions."""
    out = []
    for n in parts:
        refs, tgts = (x.repartition(n) for x in sides(planted))
        began = time.perf_counter()
        mapping_pairs(refs, tgts, identity).write.format("noop").mode("overwrite").save()
        out.append((n, time.perf_counter() - began))
    return out

