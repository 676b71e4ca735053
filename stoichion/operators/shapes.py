"""Which pairs of networks can fit, by an inverted index of reaction shapes.

The shape of a reaction is what it shares with any image of it: its class and the stoichiometry of its reactants (of its
products too, where the comparison is strict). A network is the multiset of its shapes, and a reference can only fit a
target that has each of its shapes at least as often. Postings list the networks of a shape; each reference asks only for
the postings of its anchor, the shape that the fewest targets have. What comes back is compared by signatures of bits, and what
passes those as maps. Nothing is compared that shares no anchor, and no list is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG, WEAK
from stoichion.store import saved, workspace

#: Stoichiometry is summed in millionths, so that sums don't depend on an order.
MICRO = 1_000_000
#: 64-bit words of a network's signature.
WORDS = 4


def compact(rows: DataFrame, identity: str) -> DataFrame:
    """(network, n_species, n_reactions, cells) of networks in rows, on the sides that the identity compares; products are
    rounded to 6 digits, empty cells are left out.
    """
    if identity not in (STRONG, WEAK):
        raise ValueError(f"identity must be {STRONG} or {WEAK}, not {identity}")

    def cell(x: Column) -> Column:
        r, p = x["r"], F.round(x["p"], 6)
        if identity == WEAK:
            r, p = F.greatest(F.round(r - p, 6), F.lit(0.0)), F.greatest(F.round(p - r, 6), F.lit(0.0))
        return F.struct(x["s"].alias("s"), x["j"].alias("j"), (r + 0.0).alias("r"), (p + 0.0).alias("p"))

    cells = F.filter(F.transform("cells", cell), lambda x: (x["r"] != 0) | (x["p"] != 0))
    return rows.select("network", F.size("species").alias("n_species"), F.size("reactions").alias("n_reactions"), cells.alias("cells"))


def reaction_shapes(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(network, n_species, n_reactions, shape, n): how often a network of compact() has each shape, as a 64-bit hash."""
    blank = F.transform(F.sequence(F.lit(0), F.col("n_reactions") - 1), lambda j: F.struct(F.lit(-1).alias("s"), j.alias("j"), F.lit(0.0).alias("r"), F.lit(0.0).alias("p")))
    each = rows.where("n_reactions > 0").select("network", "n_species", "n_reactions", F.explode(F.concat("cells", blank)).alias("c"))
    by = ["network", "n_species", "n_reactions"]
    # Dealt by network, so that reactions, shapes and networks are grouped without moving again.
    own = each.repartition("network").groupBy(*by, F.col("c.j").alias("j")).agg(F.sort_array(F.collect_list(F.struct("c.r", "c.p"))).alias("own"))
    kept = F.filter("own", lambda x: (x["r"] != 0) | (F.lit(strict) & (x["p"] != 0)))
    micro = lambda side: F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + F.floor(x[side] * MICRO + 0.5))
    klass = 4 * F.least(F.floor(micro("r") / MICRO), F.lit(3)) + F.least(F.floor(micro("p") / MICRO), F.lit(3))
    return own.groupBy(*by, F.xxhash64(klass, kept).alias("shape")).agg(F.count("*").alias("n"))


def kinds(rows: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """One network of rows (network, n_species, n_reactions, cells) for all that are equal cell by cell, by position, named by the least
    of them; and (network, kind) of all.
    """
    of = ["n_species", "n_reactions", "cells"]
    # A hash before the cells, so that sorts and joins compare cells only where it is equal.
    rows = rows.withColumn("cells", F.sort_array("cells")).withColumn("_hash", F.xxhash64(*of))
    one = rows.groupBy("_hash", *of).agg(F.min("network").alias("network"))
    one = saved(one.select("network", "_hash", *of), folder, name)
    members = rows.join(one.withColumnRenamed("network", "kind"), ["_hash", *of]).select("network", "kind")
    return one.drop("_hash"), saved(members, folder, f"{name}-members")


def fitting_pairs(references: DataFrame, targets: DataFrame, subset: bool = True, strict: bool = False) -> DataFrame:
    """(reference, target) of the pairs of compact() networks that have shapes enough; without subset, as many shapes and
    nodes on either side.
    """
    folder = workspace(targets.sparkSession, "shapes")
    own, far = (saved(reaction_shapes(side, strict or not subset), folder, name) for side, name in ((references, "references"), (targets, "targets")))
    rare = far.groupBy("shape").agg(F.count("*").alias("n_targets"))
    asked = own.join(rare, "shape", "left").groupBy("network", "n_species", "n_reactions").agg(
        F.min(F.struct(F.coalesce("n_targets", F.lit(0)).alias("n_targets"), "shape", "n")).alias("anchor"),
        F.collect_list(F.struct("shape", "n")).alias("need"),
    ).where("anchor.n_targets > 0").join(_signatures(own, "r"), "network")
    bits = lambda x: [f"{x}{w}" for w in range(WORDS)]
    asked = asked.select(F.col("network").alias("reference"), F.col("n_species").alias("r_species"), F.col("n_reactions").alias("r_reactions"), "need", F.col("anchor.shape").alias("shape"), F.col("anchor.n").alias("least"), *bits("r"))
    # With all shapes of the target, so that what meets is settled in the join and pairs move without them.
    whole = far.groupBy("network").agg(F.map_from_entries(F.collect_list(F.struct("shape", "n"))).alias("have"))
    postings = far.join(_signatures(far, "t"), "network").join(whole, "network").select("shape", F.col("network").alias("target"), F.col("n").alias("has"), F.col("n_species").alias("t_species"), F.col("n_reactions").alias("t_reactions"), "have", *bits("t"))
    sizes = (F.col("r_species") <= F.col("t_species")) & (F.col("r_reactions") <= F.col("t_reactions"))
    if not subset:
        sizes = (F.col("r_species") == F.col("t_species")) & (F.col("r_reactions") == F.col("t_reactions"))
    for w in range(WORDS):
        sizes = sizes & (F.col(f"r{w}").bitwiseAND(F.bitwise_not(F.col(f"t{w}"))) == 0)
    enough = F.forall("need", lambda x: F.coalesce(F.try_element_at("have", x["shape"]), F.lit(0)) >= x["n"])
    return asked.join(postings, "shape").where((F.col("has") >= F.col("least")) & sizes & enough).select("reference", "target")


def _signatures(shapes: DataFrame, prefix: str) -> DataFrame:
    """(network, prefix0, ...): bits for each shape as often as the network has it. A reference's bits are among those of any target
    that it fits, which a few machine instructions tell of most that it doesn't.
    """
    each = shapes.select("network", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"), "shape")
    bit = F.pmod(F.xxhash64("shape", "nth"), F.lit(64 * WORDS))
    word = lambda w: F.coalesce(F.bit_or(F.when(F.floor(bit / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")))), F.lit(0).cast("long"))
    return each.groupBy("network").agg(*(word(w).alias(f"{prefix}{w}") for w in range(WORDS)))
