"""Monte-Carlo significance: how often random networks hold, or equal, a reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG, WEAK, clamped_log10
from stoichion.operators.cluster import canonical_forms
from stoichion.operators.random_networks import generate
from stoichion.operators.search import mapping_counts


def subset_chance(references: DataFrame, n: int, species: int, reactions: int, identity: str = WEAK, budget: int | None = 100_000, seed: int = 0) -> DataFrame:
    """(reference, n, p_found, p_truncated) over n random targets of a size; null shares where there are none."""
    targets = generate(references.sparkSession, n, species, reactions, seed)
    found = mapping_counts(references, targets, identity, budget=budget, misses=True, first_only=True)
    return found.groupBy("reference").agg(F.count("*").alias("n"), F.avg((F.col("n_pairs") > 0).cast("double")).alias("p_found"), F.avg(F.col("is_truncated").cast("double")).alias("p_truncated"))


def equal_chance(references: DataFrame, n: int, species: int, reactions: int, identity: str = STRONG, seed: int = 0) -> DataFrame:
    """(reference, n, p_equal): the share of n random networks of exactly that size that equal a reference, by an
    equi-join of canonical forms.
    """
    targets = canonical_forms(generate(references.sparkSession, n, species, reactions, seed, "exact"), identity)
    total = targets.agg(F.count("*").alias("n"))
    same = targets.groupBy("form").agg(F.count("*").alias("same"))
    own = canonical_forms(references, identity).select(F.col("network").alias("reference"), "form")
    met = own.join(same, "form", "left").crossJoin(F.broadcast(total))
    return met.select("reference", "n", F.when(F.col("n") > 0, F.coalesce("same", F.lit(0)) / F.col("n")).alias("p_equal"))


def occurrence(spark: SparkSession, sizes: list[tuple[int, int]], replications: int, n: int, identity: str = WEAK, seed: int = 0) -> DataFrame:
    """For each size, over random references: mean and deviation of the share of random networks that equal them, and
    the significance round(-log10(max(mean, 1e-5))).
    """
    parts = []
    for s, j in sizes:
        refs = generate(spark, replications, s, j, seed + 1, "exact")
        parts.append(equal_chance(refs, n, s, j, identity, seed).select(F.lit(s).alias("num_species"), F.lit(j).alias("num_reaction"), "p_equal"))
    out = reduce(DataFrame.unionByName, parts).groupBy("num_species", "num_reaction").agg(F.avg("p_equal").alias("mean_probability"), F.stddev_pop("p_equal").alias("std_probability"))
    return out.withColumn("poc_significance", F.round(clamped_log10(F.col("mean_probability"))))


def null_grid(spark: SparkSession, references: DataFrame, sizes: list[int], n: int, identity: str = WEAK, budget: int | None = 100_000, seed: int = 0) -> DataFrame:
    """subset_chance() for target sizes, species and reactions alike."""
    return reduce(DataFrame.unionByName, [subset_chance(references, n, k, k, identity, budget, seed).withColumn("target_size", F.lit(k)) for k in sizes])


def collisions(spark: SparkSession, sizes: list[tuple[int, int]], n: int, seed: int = 0) -> DataFrame:
    """For each size: random networks, distinct keys of sorted rows and columns, and networks that share a key with one
    they don't equal.
    """
    from stoichion.model import from_nested
    from stoichion.operators.matrix import canonical_key
    from stoichion.operators.projection import net

    parts = []
    for s, j in sizes:
        rows = generate(spark, n, s, j, seed, "uniform")
        crn = from_nested(rows)
        cells = net(crn.cells).select("network", F.col("species").alias("row"), F.col("reaction").alias("col"), F.col("net").alias("value"))
        key = canonical_key(cells, crn.species.withColumnRenamed("species", "row"), crn.reactions.withColumnRenamed("reaction", "col"), ["network"])
        form = canonical_forms(rows, WEAK).select("network", "form")
        at = key.join(form, "network").groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("form").alias("forms"))
        parts.append(at.agg(F.sum("n").alias("num_network"), F.count("*").alias("num_unique_hash"), F.sum(F.col("forms") - 1).alias("num_collision"), F.max("n").alias("max_network_in_hash")).select(F.lit(s).alias("num_species"), F.lit(j).alias("num_reaction"), "*"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("percent_collision", 100 * F.col("num_collision") / F.col("num_network"))
