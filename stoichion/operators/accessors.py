"""Look-ups and merges of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clusters_by_size(clusters: DataFrame, least: int | None = None) -> DataFrame:
    """(cluster, n, networks) of the clusters (cluster, network) with so many networks or more, by default the largest ones."""
    own = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("network")).alias("networks"))
    if least is not None:
        return own.where(F.col("n") >= least)
    return own.join(F.broadcast(own.agg(F.max("n").alias("n"))), "n", "left_semi")


def key_sizes(keys: DataFrame, least: int | None = None) -> DataFrame:
    """(cluster, n): clusters_by_size() of networks (network, key) that are together if their keys are equal, without a list of them,
    so that no cluster's members come together.
    """
    own = keys.groupBy("key").agg(F.min("network").alias("cluster"), F.count("*").alias("n")).select("cluster", "n")
    if least is not None:
        return own.where(F.col("n") >= least)
    return own.join(F.broadcast(own.agg(F.max("n").alias("n"))), "n", "left_semi").select("cluster", "n")


def clean_label(name: Column, prefix: str = "") -> Column:
    """A directory's name without the prefix and without what follows its last underscore."""
    return F.regexp_replace(F.regexp_replace(name, f"^{prefix}", ""), "_[^_]*$", "")


def aggregated(members: DataFrame, by: str) -> DataFrame:
    """(by, n, p_duplicate, p_indeterminate) of cluster members (by, cluster, network, is_indeterminate): the shares of networks that
    another one equals, and of those undecided.
    """
    size = F.count("*").over(Window.partitionBy(by, "cluster"))
    at = members.withColumn("_size", size)
    return at.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("_size") > 1).cast("double")).alias("p_duplicate"), F.avg(F.col("is_indeterminate").cast("double")).alias("p_indeterminate"))


def subnet_data(results: DataFrame, sizes: DataFrame, skip: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Pairs of results (reference, target, n_pairs) that were found, with the sizes of both networks (network, n_species,
    n_reactions); without references in skip (network) and pairs in done (reference, target).
    """
    found = results.where("n_pairs > 0")
    if skip is not None:
        found = found.join(skip.select(F.col("network").alias("reference")).distinct(), "reference", "left_anti")
    if done is not None:
        found = found.join(done.select("reference", "target").distinct(), ["reference", "target"], "left_anti")
    side = lambda x: sizes.select(F.col("network").alias(x), F.col("n_species").alias(f"{x}_species"), F.col("n_reactions").alias(f"{x}_reactions"))
    return found.join(side("reference"), "reference").join(side("target"), "target")


def worker_path(base: str, worker: int) -> str:
    """base.ext becomes base_worker.ext."""
    stem, dot, extension = base.rpartition(".")
    return f"{stem}_{worker}{dot}{extension}" if dot and "/" not in extension else f"{base}_{worker}"


def merge_workers(spark: SparkSession, base: str, workers: int) -> tuple[DataFrame | None, int]:
    """Rows of the Parquet files of all workers that have any, and how many references they hold."""
    from stoichion.operators.report import merge
    from stoichion.plans.finder import checkpoint_rows

    parts = [x for x in (checkpoint_rows(spark, worker_path(base, i)) for i in range(workers)) if x is not None]
    if not parts:
        return None, 0
    rows = merge(parts)
    return rows, rows.select("reference").distinct().count()


def delete_workers(spark: SparkSession, base: str, workers: int) -> int:
    """Removes the workers' files; how many there were."""
    return sum(delete(spark, worker_path(base, i)) for i in range(workers))


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder in any store that Spark reads; whether there was one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True))


def read_work_units(spark: SparkSession, path: str, worker: int | None = None) -> DataFrame:
    """Work units in CSV, all or those of one worker."""
    rows = spark.read.csv(path, header=True, inferSchema=False).withColumn("worker_idx", F.col("worker_idx").cast("int"))
    return rows if worker is None else rows.where(F.col("worker_idx") == worker)


def metric_by(df: DataFrame, conditions: list[str], metric: str, log: bool = False, least: float = 1e-5) -> DataFrame:
    """(conditions, mean, std_pop, n) of a metric, or of log10 of it, by every combination of conditions."""
    value = F.log10(F.greatest(F.col(metric), F.lit(least))) if log else F.col(metric)
    return df.groupBy(*conditions).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.count("*").alias("n"))
