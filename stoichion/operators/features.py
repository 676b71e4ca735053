"""Features of species and reactions that any embedding preserves, and the registry of those in use.

Each builder takes networks whose cells are already projected and returns long rows (network, node, feature, value);
nodes without a feature have no row, and 0 is meant. Kind `eq` features must be equal in reference and target, `le`
features may only grow, `bits` features may only gain bits; where whole networks are compared all must be equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoichion.model import Crn
from stoichion.operators.projection import reaction_classes
from stoichion.store import saved, workspace

REACTION, SPECIES = "reaction", "species"


def one_step(crn: Crn, kind: str) -> DataFrame:
    """(network, a, b): species b is made by a reaction that uses a, or reaction b uses what a makes."""
    via, node = ("reaction", "species") if kind == SPECIES else ("species", "reaction")
    first, second = ("r", "p") if kind == SPECIES else ("p", "r")
    left = crn.cells.where(f"{first} > 0").select("network", via, F.col(node).alias("a"))
    right = crn.cells.where(f"{second} > 0").select("network", via, F.col(node).alias("b"))
    return left.join(right, ["network", via]).select("network", "a", "b").distinct()


def steps(crn: Crn, kind: str, n: int) -> DataFrame:
    """(network, a, b): b is reached from a in exactly n steps; a itself may be."""
    one = one_step(crn, kind)
    out = one
    for _ in range(n - 1):
        out = _further(out, one)
    return out


def _further(out: DataFrame, one: DataFrame) -> DataFrame:
    """One step on."""
    return out.withColumnRenamed("b", "via").join(one.select("network", F.col("a").alias("via"), "b"), ["network", "via"]).select("network", "a", "b").distinct()


def reached(crn: Crn, kind: str, depth: int = 2) -> DataFrame:
    """(network, node, to, side, n): to is reached from node in n steps, forward (side s) and backward (p)."""
    # Single steps are written, as every number of steps starts from them.
    one = saved(one_step(crn, kind), workspace(crn.cells.sparkSession, "steps"), "one")
    rows, out = one.withColumn("n", F.lit(1)), one
    for n in range(2, depth + 1):
        out = _further(out, one)
        rows = rows.unionByName(out.withColumn("n", F.lit(n)))
    way = lambda side, node, to: F.struct(F.lit(side).alias("side"), F.col(node).alias("node"), F.col(to).alias("to"))
    return rows.select("network", "n", F.inline(F.array(way("s", "a", "b"), way("p", "b", "a"))))


def degree_steps(crn: Crn, kind: str) -> DataFrame:
    """Nodes reached in one and two steps, forward (s_1, s_2) and backward (p_1, p_2)."""
    name = F.concat_ws("_", "side", "n").alias("feature")
    return reached(crn, kind).groupBy("network", "node", name).agg(F.count("*").alias("value")).select("network", "node", "feature", "value")


def n_step_classes(crn: Crn, kind: str, depth: int = 2) -> DataFrame:
    """For each step count and direction, the reactions of each class at the nodes reached: for reactions the nodes
    themselves, for species weighted by their stoichiometry as reactants.
    """
    classes = reaction_classes(crn)
    if kind == REACTION:
        weight = classes.select("network", F.col("reaction").alias("to"), "class", F.lit(1).alias("w"))
    else:
        weight = crn.cells.where("r > 0").join(classes, ["network", "reaction"]).groupBy("network", F.col("species").alias("to"), "class").agg(F.sum("r").alias("w"))
    met = reached(crn, kind, depth).join(weight, ["network", "to"]).groupBy("network", "node", "side", "n", "class").agg(F.sum("w").alias("value"))
    return met.select("network", "node", F.concat("side", "n", F.lit("_"), "class").alias("feature"), "value")


def _roles(cells: DataFrame) -> DataFrame:
    """cells once for each side that has any: side (r or p) and its stoichiometry."""
    one = lambda c: F.when(F.col(c) > 0, F.struct(F.lit(c).alias("side"), F.col(c).alias("amount")))
    return cells.select("*", F.inline(F.array_compact(F.array(one("r"), one("p")))))


def role_classes(crn: Crn) -> DataFrame:
    """For each species and class the number of reactions of it that use (r_) and that make (p_) the species."""
    met = _roles(crn.cells.join(reaction_classes(crn), ["network", "reaction"]))
    n = met.groupBy("network", F.col("species").alias("node"), "side", "class").agg(F.count("*").alias("value"))
    return n.select("network", "node", F.concat_ws("_", "side", "class").alias("feature"), "value")


def role_bits(crn: Crn) -> DataFrame:
    """For each species the classes of the reactions that use and make it, as bits."""
    met = _roles(crn.cells.join(reaction_classes(crn), ["network", "reaction"]))
    return met.groupBy("network", F.col("species").alias("node"), F.col("side").alias("feature")).agg(F.bit_or(F.expr("shiftleft(1, class)").cast("bigint")).alias("value"))


def role_totals(crn: Crn) -> DataFrame:
    """For each species the sum of its stoichiometry as reactant and as product."""
    return _roles(crn.cells).groupBy("network", F.col("species").alias("node"), F.concat(F.lit("sum_"), "side").alias("feature")).agg(F.sum("amount").alias("value"))


def species_autocatalysis(crn: Crn) -> DataFrame:
    """For each species the number of reactions with it on both sides."""
    own = crn.cells.where("r > 0 AND p > 0").groupBy("network", F.col("species").alias("node")).agg(F.count("*").alias("value"))
    return own.select("network", "node", F.lit("both").alias("feature"), "value")


def reaction_autocatalysis(crn: Crn) -> DataFrame:
    """1 for reactions with a species on both sides."""
    return crn.cells.where("r > 0 AND p > 0").select("network", F.col("reaction").alias("node"), F.lit("both").alias("feature"), F.lit(1).alias("value")).distinct()


def class_feature(crn: Crn) -> DataFrame:
    """The class of a reaction, from 1, so that no row differs from class 0."""
    return reaction_classes(crn).select("network", F.col("reaction").alias("node"), F.lit("class").alias("feature"), (F.col("class") + 1).alias("value"))


@dataclass(frozen=True)
class FeatureSpec:
    """A family of features; short is its letter in the names of sets, default whether a search uses it."""

    name: str
    short: str
    node: str
    kind: str
    build: Callable[[Crn], DataFrame]
    default: bool


REGISTRY = [
    FeatureSpec("n_step", "a", SPECIES, "le", lambda c: n_step_classes(c, SPECIES), True),
    FeatureSpec("reactant_product", "b", SPECIES, "le", role_classes, True),
    FeatureSpec("n_step", "y", REACTION, "le", lambda c: n_step_classes(c, REACTION), True),
    FeatureSpec("classification", "z", REACTION, "eq", class_feature, True),
    FeatureSpec("autocatalysis", "c", SPECIES, "le", species_autocatalysis, False),
    FeatureSpec("reactant_product_count", "d", SPECIES, "le", role_totals, False),
    FeatureSpec("bitwise", "e", SPECIES, "bits", role_bits, False),
    FeatureSpec("successor_predecessor", "f", SPECIES, "le", lambda c: degree_steps(c, SPECIES), False),
    FeatureSpec("autocatalysis", "v", REACTION, "eq", reaction_autocatalysis, False),
    FeatureSpec("successor_predecessor", "w", REACTION, "le", lambda c: degree_steps(c, REACTION), False),
]


def register(spec: FeatureSpec) -> None:
    """Adds a family of one's own; its letter must be new."""
    if any(x.short == spec.short for x in REGISTRY):
        raise ValueError(f"the letter {spec.short} is taken")
    REGISTRY.append(spec)


def chosen(node: str, short: str | None = None) -> list[FeatureSpec]:
    """Families by a name like `a+b` or `none`; those of default without one."""
    own = [s for s in REGISTRY if s.node == node]
    if short is None:
        return [s for s in own if s.default]
    letters = [] if short == "none" else short.split("+")
    unknown = set(letters) - {s.short for s in own}
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    return [s for s in own if s.short in letters]


def short_name(specs: list[FeatureSpec]) -> str:
    return "+".join(sorted(s.short for s in specs)) or "none"


def long_name(specs: list[FeatureSpec]) -> str:
    return "+".join(s.name for s in sorted(specs, key=lambda s: s.short)) or "none"


def option_sets(node: str) -> list[list[FeatureSpec]]:
    """Every subset of the default families, smaller ones first."""
    own = chosen(node)
    return [list(x) for x in chain.from_iterable(combinations(own, n) for n in range(len(own) + 1))]


def feature_rows(crn: Crn, node: str, specs: list[FeatureSpec] | None = None) -> DataFrame:
    """(network, node, kind, feature, value) of the families given."""
    rows = None
    for s in chosen(node) if specs is None else specs:
        own = s.build(crn).select("network", "node", F.lit(s.kind).alias("kind"), F.concat(F.lit(f"{s.short}:"), "feature").alias("feature"), F.col("value").cast("double").alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        nodes = crn.species.withColumnRenamed("species", "node") if node == SPECIES else crn.reactions.withColumnRenamed("reaction", "node")
        rows = nodes.select("network", "node", F.lit("le").alias("kind"), F.lit("none").alias("feature"), F.lit(0.0).alias("value")).where("false")
    return rows


def wide(rows: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """(network, node, a column for each feature), 0 where a node has none."""
    out = rows.groupBy("network", "node").agg(*(F.sum(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names))
    return nodes.join(out, ["network", "node"], "left").select("network", "node", *(F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names))

