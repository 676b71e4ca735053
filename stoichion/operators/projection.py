"""Projections and predicates of networks: net change, classes, boundary networks, text, graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoichion.functions.columns import LABELS, STRONG, class_code, class_index, class_label, project
from stoichion.model import Crn, gathered


def net(cells: DataFrame) -> DataFrame:
    """(network, reaction, species, net): product minus reactant, zeros too."""
    return cells.select("network", "reaction", "species", (F.col("p") - F.col("r")).alias("net"))


def reaction_classes(crn: Crn) -> DataFrame:
    """(network, reaction, class): 0 to 15, for reactions without cells too."""
    sums = crn.cells.groupBy("network", "reaction").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    if crn.complete:
        return sums.select("network", "reaction", class_index(zero("r"), zero("p")).alias("class"))
    return crn.reactions.join(sums, ["network", "reaction"], "left").select("network", "reaction", class_index(zero("r"), zero("p")).alias("class"))


def described_classes(crn: Crn) -> DataFrame:
    """reaction_classes() with code and label."""
    return reaction_classes(crn).select("network", "reaction", class_code(F.col("class")).alias("code"), class_label(F.col("class")).alias("label"))


def class_onehot(crn: Crn) -> DataFrame:
    """A column for each class, 1 where the reaction has it."""
    return reaction_classes(crn).select("network", "reaction", *(F.when(F.col("class") == i, 1).otherwise(0).alias(f"c{i}") for i in range(16)))


def class_histogram(crn: Crn) -> DataFrame:
    """(label, n) for all sixteen classes, those without reactions too."""
    spark = crn.cells.sparkSession
    every = spark.range(len(LABELS)).select(F.col("id").cast("int").alias("class"))
    n = reaction_classes(crn).groupBy("class").agg(F.count("*").alias("n"))
    return every.join(n, "class", "left").select(class_label(F.col("class")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def boundary_networks(crn: Crn) -> DataFrame:
    """(network, is_boundary): whether each reaction has one species at most, on either side together."""
    total = crn.cells.groupBy("network", "reaction").agg(F.sum(F.col("r") + F.col("p")).alias("n"))
    most = total.groupBy("network").agg(F.max("n").alias("n"))
    return crn.reactions.select("network").distinct().join(most, "network", "left").select("network", (F.coalesce("n", F.lit(0)) <= 1).alias("is_boundary"))


def sizes(crn: Crn) -> DataFrame:
    """(network, n_species, n_reactions)."""
    if crn.complete:
        n = lambda c: F.size(F.collect_set(c)).cast("long").alias(f"n_{c}")
        own = crn.cells.groupBy("network").agg(n("species"), n("reaction"))
        return own.select("network", "n_species", F.col("n_reaction").alias("n_reactions"))
    count = lambda df, c: df.groupBy("network").agg(F.count("*").alias(c))
    both = count(crn.species, "n_species").join(count(crn.reactions, "n_reactions"), "network", "full")
    return both.select("network", F.coalesce("n_species", F.lit(0)).alias("n_species"), F.coalesce("n_reactions", F.lit(0)).alias("n_reactions"))


def _term(n: Column, species: Column) -> Column:
    return F.when(F.abs(n - 1) < 1e-9, species).otherwise(F.concat_ws(" ", n.cast("double").cast("string"), species))


def pretty_reactions(crn: Crn) -> DataFrame:
    """(network, reaction, text) as `name: 2.0 A + B -> C`, species in the order of their names."""
    parts = F.sort_array(F.collect_list(F.struct("species", F.col("r").cast("double").alias("r"), F.col("p").cast("double").alias("p"))))
    side = lambda c: F.array_join(F.transform(F.filter("parts", lambda x: x[c] > 0), lambda x: _term(x[c], x["species"])), " + ")
    own = crn.cells.groupBy("network", "reaction").agg(parts.alias("parts"))
    df = crn.reactions.join(own, ["network", "reaction"], "left")
    left, right = (F.coalesce(side(c), F.lit("")) for c in ("r", "p"))
    return df.select("network", "reaction", F.concat(F.col("reaction").cast("string"), F.lit(": "), left, F.lit(" -> "), right).alias("text"))


def pretty_networks(crn: Crn) -> DataFrame:
    """(network, text): name and sizes, then a line for each reaction."""
    lines = pretty_reactions(crn).groupBy("network").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reaction", "text"))), lambda x: F.concat(F.lit("\n   "), x["text"])), "").alias("lines"))
    head = F.concat(F.col("network").cast("string"), F.lit(": "), F.col("n_species"), F.lit(" species, "), F.col("n_reactions"), F.lit(" reactions"))
    return sizes(crn).join(lines, "network", "left").select("network", F.concat(head, F.coalesce("lines", F.lit(""))).alias("text"))


def bipartite_edges(crn: Crn, identity: str = STRONG) -> DataFrame:
    """(network, src, dst, nth): the edges of the graph of species and reactions, as many as the stoichiometry says."""
    cells = crn.projected(identity).cells
    one = lambda src, dst, n: cells.where(F.col(n) >= 1).select("network", F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.explode(F.sequence(F.lit(1), F.floor(n).cast("int"))).alias("nth"))
    return one("species", "reaction", "r").union(one("reaction", "species", "p"))


def edge_list_text(crn: Crn, identity: str = STRONG) -> DataFrame:
    """(network, text): `src>dst` lines, then `node,,label` lines."""
    own = gathered(crn)
    times = lambda n: F.coalesce(F.floor(n).cast("int"), F.lit(0))

    def lines(x: Column) -> Column:
        r, p = project(x["r"], x["p"], identity)
        s, j = x["species"].cast("string"), x["reaction"].cast("string")
        return F.concat(F.array_repeat(F.concat_ws(">", s, j), times(r)), F.array_repeat(F.concat_ws(">", j, s), times(p)))

    node = lambda names, label: F.transform(names, lambda x: F.concat(x.cast("string"), F.lit(f",,{label}")))
    edges = F.sort_array(F.flatten(F.transform("cells", lines)))
    nodes = F.sort_array(F.concat(node("species_list", "species"), node("reaction_list", "reaction")))
    return own.select("network", F.array_join(F.concat(edges, nodes), "\n").alias("text"))


def is_nonempty(crn: Crn) -> DataFrame:
    """(network, is_nonempty): whether a network has a species and a reaction."""
    return sizes(crn).select("network", ((F.col("n_species") > 0) & (F.col("n_reactions") > 0)).alias("is_nonempty"))


def equivalent(a: Crn, b: Crn) -> DataFrame:
    """(network, is_equivalent) for networks of one name in a and b: the same species, reactions and stoichiometry."""
    key = lambda crn, side: crn.cells.groupBy("network").agg(F.sort_array(F.collect_list(F.struct("reaction", "species", F.col("r").cast("double").alias("r"), F.col("p").cast("double").alias("p")))).alias(f"cells_{side}"))
    names = lambda df, c, side: df.groupBy("network").agg(F.sort_array(F.collect_set(c)).alias(f"{c}_{side}"))
    out = a.reactions.select("network").union(a.species.select("network")).distinct().join(b.reactions.select("network").union(b.species.select("network")).distinct(), "network")
    for crn, side in ((a, "a"), (b, "b")):
        for part in (names(crn.species, "species", side), names(crn.reactions, "reaction", side), key(crn, side)):
            out = out.join(part, "network", "left")
    same = lambda c: F.to_json(F.struct(F.col(f"{c}_a").alias("x"))).eqNullSafe(F.to_json(F.struct(F.col(f"{c}_b").alias("x"))))
    return out.select("network", (same("species") & same("reaction") & same("cells")).alias("is_equivalent"))
