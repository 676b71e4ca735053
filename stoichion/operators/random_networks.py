"""Random networks from seeds: every row depends on its number and the seed alone, so that a lost task gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoichion.model import NESTED
from stoichion.operators.search import Net

# Shares of reactions by number of products (rows, 0 to 3) and of reactants (columns, 0 to 3).
SHARES = [
    [0.0, 0.1358, 0.001, 0.0],
    [0.0978, 0.3364, 0.1874, 0.0011],
    [0.0005, 0.1275, 0.0683, 0.0055],
    [0.0, 0.0087, 0.0154, 0.0146],
]


def _row(name: str, species: int, reactant: np.ndarray, product: np.ndarray) -> dict:
    cells = [{"s": int(s), "j": int(j), "r": float(reactant[s, j]), "p": float(product[s, j])} for s, j in zip(*np.nonzero(reactant + product), strict=True)]
    return {"network": name, "species": [f"S{i}" for i in range(species)], "reactions": [f"J{j}" for j in range(reactant.shape[1])], "cells": cells}


def uniform(rng: np.random.Generator, name: str, species: int, reactions: int) -> dict:
    """Stoichiometry 0, 1 or 2 in every cell of either side."""
    return _row(name, species, rng.integers(0, 3, (species, reactions)), rng.integers(0, 3, (species, reactions)))


def by_type(rng: np.random.Generator, name: str, species: int, reactions: int, shares: list[list[float]] | None = None, prune: bool = True) -> dict:
    """Reactions by the shares of their types, species drawn uniformly; species in no reaction go if prune is set."""
    odds = np.array(SHARES if shares is None else shares, float)
    types = [(r, p) for p in range(4) for r in range(4)]
    odds = odds.ravel() / odds.sum()
    reactant, product = np.zeros((species, reactions), int), np.zeros((species, reactions), int)
    for j, t in enumerate(rng.choice(len(types), reactions, p=odds)):
        for side, n in zip((reactant, product), types[t], strict=True):
            np.add.at(side[:, j], rng.integers(0, species, n), 1)
    if prune:
        used = np.flatnonzero((reactant + product).any(axis=1))
        reactant, product = reactant[used], product[used]
    return _row(name, len(reactant), reactant, product)


def exact_by_type(rng: np.random.Generator, name: str, species: int, reactions: int, tries: int = 100_000) -> dict | None:
    """by_type() with exactly so many species in use, or None after so many tries."""
    for _ in range(tries):
        row = by_type(rng, name, species, reactions)
        if len(row["species"]) == species:
            return row
    return None


def permuted(rng: np.random.Generator, row: dict) -> tuple[dict, list[int], list[int]]:
    """A network with its nodes in another order, and where each node went."""
    s, j = rng.permutation(len(row["species"])).tolist(), rng.permutation(len(row["reactions"])).tolist()
    names = lambda old, to: [x for _, x in sorted(zip(to, old, strict=True))]
    cells = [{"s": s[c["s"]], "j": j[c["j"]], "r": c["r"], "p": c["p"]} for c in row["cells"]]
    return {"network": row["network"], "species": names(row["species"], s), "reactions": names(row["reactions"], j), "cells": cells}, s, j


def embedded(rng: np.random.Generator, row: dict, more_species: int, more_reactions: int, shared: bool = False) -> tuple[dict, list[int], list[int]]:
    """A target that holds a network: beside it a random one, of its own species or, if shared, making its species too,
    in random order; with the places of the network's nodes.
    """
    if more_species < 1 or more_reactions < 1:
        raise ValueError("a filler has a species and a reaction at least")
    filler = by_type(rng, "filler", more_species, more_reactions, prune=False)
    n, m = len(row["species"]), len(row["reactions"])
    cells = [*row["cells"], *({"s": c["s"] + n, "j": c["j"] + m, "r": c["r"], "p": c["p"]} for c in filler["cells"])]
    if shared and n:
        cells += [{"s": int(rng.integers(0, n)), "j": m + j, "r": 0.0, "p": 1.0} for j in range(more_reactions)]
    whole = {"network": f"{row['network']}-target", "species": [*row["species"], *(f"F{i}" for i in range(more_species))], "reactions": [*row["reactions"], *(f"G{j}" for j in range(more_reactions))], "cells": cells}
    out, s, j = permuted(rng, whole)
    return out, s[:n], j[:m]


def generate(spark: SparkSession, n: int, species: int, reactions: int, seed: int = 0, kind: str = "type") -> DataFrame:
    """n networks in rows. kind: uniform, type, or exact (types, exactly so many species; rows without one are left out)."""
    make = {"uniform": uniform, "type": by_type, "exact": exact_by_type}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [make(np.random.default_rng([seed, species, reactions, int(i)]), f"N{species}x{reactions}-{i}", species, reactions) for i in batch["id"]]
            yield pd.DataFrame([r for r in rows if r is not None], columns=["network", "species", "reactions", "cells"])

    return spark.range(n).mapInPandas(run, NESTED)


def experiments(spark: SparkSession, n: int, species: int, reactions: int, more: int, identical: bool = True, seed: int = 0) -> DataFrame:
    """(id, reference, target, species_at, reactions_at): planted pairs with their mapping; without identical, a
    reference that one changed cell keeps from fitting.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                ref = by_type(rng, f"R{i}", species, reactions)
                tgt, s, j = embedded(rng, ref, more, more)
                if not identical and ref["cells"]:
                    ref["cells"][0]["r"] = 1.0 + max(c["r"] for c in tgt["cells"])
                rows.append((int(i), ref, tgt, s, j))
            yield pd.DataFrame(rows, columns=["id", "reference", "target", "species_at", "reactions_at"])

    row = f"struct<{NESTED.replace(' array', ':array').replace('network string', 'network:string')}>"
    return spark.range(n).mapInPandas(run, f"id long, reference {row}, target {row}, species_at array<int>, reactions_at array<int>")


def trinary(spark: SparkSession, n: int, rows: int, columns: int, seed: int = 0) -> DataFrame:
    """(id, row, col, value): matrices of -1, 0 and 1 from hashes of their places."""
    grid = spark.range(n).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    return grid.withColumn("value", (F.pmod(F.xxhash64("id", "row", "col", F.lit(seed)), F.lit(3)) - 1).cast("int"))


def as_net(row: dict, identity: str) -> Net:
    return Net.of(row, identity)
