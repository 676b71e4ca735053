"""Significance of matches: how often a reference fits a target whose reactants and products have been switched around.

The null model of a target keeps, on either side, how many species each reaction has, how many reactions each species is in, and all
stoichiometry: a step takes two cells of one side and exchanges their species, unless a species would stand twice on the side of a
reaction. Many steps make a sample. Samples are drawn from the given networks, by a seed and their names, so that
a rerun draws the same.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG, clamped_log10
from stoichion.model import few
from stoichion.operators.search import catalogues, to_arrow, within
from stoichion.operators.shapes import fitting_pairs

#: Switches that are tried for each cell.
STEPS = 20

Edge = tuple[int, int, float]


def switched(edges: list[Edge], steps: int, rng: random.Random) -> list[Edge]:
    """One side (species, reaction, stoichiometry) after so many steps for each cell."""
    edges = list(edges)
    taken = {(s, j) for s, j, _ in edges}
    n, draw = len(edges), rng.randrange
    for _ in range(steps * n if n > 1 else 0):
        # The draws of rng.sample(range(n), 2), without its lists.
        a = draw(n)
        if n <= 21:
            b = draw(n - 1)
            b = n - 1 if b == a else b
        else:
            b = draw(n)
            while b == a:
                b = draw(n)
        (s, j, x), (t, k, y) = edges[a], edges[b]
        if s == t or j == k or (t, j) in taken or (s, k) in taken:
            continue
        taken -= {(s, j), (t, k)}
        taken |= {(t, j), (s, k)}
        edges[a], edges[b] = (t, j, x), (s, k, y)
    return edges


def samples(networks: DataFrame, n: int, steps: int = STEPS, seed: int = 0) -> DataFrame:
    """n samples of each network in a row, with the number of the sample; names are NAME#NUMBER."""
    rows = networks.select("network", "species", "reactions", "cells").withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    kind = rows.select("*", F.col("network").alias("original")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow(kind)
        for batch in few(batches):
            out = []
            for x in batch.to_pylist():
                rng = random.Random(f"{x['network']}#{x['sample']}#{seed}")
                sides = {c: sorted((e["s"], e["j"], e[c]) for e in x["cells"] if e[c]) for c in "rp"}
                cells: dict[tuple[int, int], dict] = {}
                for c, edges in sides.items():
                    for s, j, v in switched(edges, steps, rng):
                        cells.setdefault((s, j), {"s": s, "j": j, "r": 0.0, "p": 0.0})[c] = v
                out.append(x | {"original": x["network"], "network": f"{x['network']}#{x['sample']}", "cells": [cells[k] for k in sorted(cells)]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    # By number, as few rows may be much work.
    parts = max(int(networks.sparkSession.conf.get("spark.sql.shuffle.partitions")), networks.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, "network", "sample").mapInArrow(run, kind)


def significance(pairs: DataFrame, references: DataFrame, targets: DataFrame, n: int, identity: str = STRONG, budget: int | None = 100_000, steps: int = STEPS, seed: int = 0) -> DataFrame:
    """(reference, target, n_samples, n_found, n_truncated, p, significance) of pairs (reference, target) of networks in rows: in how many of n samples
    of the target the reference fits, and -log10 of that share (1e-5 at least). Samples of a target serve all its references.
    """
    asked = pairs.select("reference", "target").distinct()
    own = targets.join(asked.select(F.col("target").alias("network")).distinct(), "network", "left_semi")
    refs = references.join(asked.select(F.col("reference").alias("network")).distinct(), "network", "left_semi")
    drawn = samples(own, n, steps, seed)
    sides = catalogues(refs, drawn.drop("sample", "original"), identity)
    original = F.regexp_extract(F.col("target"), r"(?s)^(.*)#\d+$", 1)
    fit = fitting_pairs(sides.references, sides.targets).withColumn("original", original)
    fit = fit.join(asked.withColumnRenamed("target", "original"), ["reference", "original"], "left_semi").select("reference", "target")
    met = within(sides, fit, budget).groupBy("reference", original.alias("target")).agg(F.count_if("is_found").alias("n_found"), F.count_if(~F.col("is_found")).alias("n_truncated"))
    out = asked.join(met, ["reference", "target"], "left").select("reference", "target", F.lit(n).cast("long").alias("n_samples"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"))
    return out.withColumn("p", F.col("n_found") / F.col("n_samples")).withColumn("significance", clamped_log10(F.col("p")))
