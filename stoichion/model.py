"""The tables of reaction networks.

cells (network, reaction, species, r, p): a row for each species in a reaction, its stoichiometry as reactant and as
product; cells without either are absent. species (network, species) and reactions (network, reaction) hold every
node, those without cells too. nested (network, species, reactions, cells) has a network in a row, nodes in order and
cells by position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoichion.functions.columns import project
from stoichion.store import saved, workspace

#: A network in a row.
NESTED = "network string, species array<string>, reactions array<string>, cells array<struct<s:int,j:int,r:double,p:double>>"


@dataclass
class Crn:
    """Networks as three tables; complete says that all nodes have cells."""

    cells: DataFrame
    species: DataFrame
    reactions: DataFrame
    complete: bool = False

    def where(self, networks: DataFrame) -> Crn:
        """Those networks whose name stands in the column network of another table."""
        own = networks.select("network").distinct()
        return Crn(*(x.join(own, "network", "left_semi") for x in (self.cells, self.species, self.reactions)), self.complete)

    def saved(self, folder: str, name: str) -> Crn:
        """The same, written below folder, so that what is built on it more than once starts from there."""
        if self.complete:
            return from_cells(saved(self.cells, folder, name))
        return Crn(*(saved(x, folder, f"{name}-{n}") for n, x in (("cells", self.cells), ("species", self.species), ("reactions", self.reactions))))

    def projected(self, identity: str) -> Crn:
        """The sides that an identity compares; nodes stay though cells may vanish."""
        r, p = project(F.col("r"), F.col("p"), identity)
        cells = self.cells.select("network", "reaction", "species", r.alias("r"), p.alias("p"))
        return Crn(cells.where("r > 0 OR p > 0"), self.species, self.reactions)


def from_cells(cells: DataFrame) -> Crn:
    """Networks whose nodes all have cells."""
    return Crn(cells, cells.select("network", "species").distinct(), cells.select("network", "reaction").distinct(), True)


def crn_view(spark: SparkSession, sf_dir: str) -> Crn:
    """Networks made of the order tables: a customer is a network, an order a reaction, a part type a species; lines
    returned are reactants, lines accepted products, and others don't count. Cells are written, as queries read them several times.
    """
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    lines = read("lineitem", "l_orderkey", "l_partkey", "l_returnflag").where("l_returnflag IN ('R', 'A')")
    typed = lines.join(read("part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    flag = lambda x: F.count_if(F.col("l_returnflag") == x)
    sides = typed.groupBy("l_orderkey", "p_type").agg(flag("R").alias("r"), flag("A").alias("p"))
    orders = read("orders", "o_orderkey", "o_custkey")
    cells = sides.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    named = cells.select(F.col("o_custkey").alias("network"), F.col("l_orderkey").alias("reaction"), F.col("p_type").alias("species"), "r", "p")
    return from_cells(saved(named, workspace(spark, "crn"), "cells"))


def nested(crn: Crn, by_name: bool = True) -> DataFrame:
    """A row for each network, nodes sorted by name; a network's nodes are gathered in one row, as any search needs."""
    df = gathered(crn)
    at = lambda names, x: (F.array_position(names, x) - 1).cast("int")
    placed = F.transform(
        "cells",
        lambda x: F.struct(at(F.col("species_list"), x["species"]).alias("s"), at(F.col("reaction_list"), x["reaction"]).alias("j"), x["r"].alias("r"), x["p"].alias("p")),
    )
    return df.select(
        F.col("network").cast("string").alias("network"), F.col("species_list").cast("array<string>").alias("species"),
        F.col("reaction_list").cast("array<string>").alias("reactions"), placed.alias("cells"),
    )


def gathered(crn: Crn) -> DataFrame:
    """(network, species_list, reaction_list, cells): nodes sorted by name, and cells with their names. Where all nodes have cells, these
    move once and tell the names.
    """
    cells = crn.cells.groupBy("network").agg(F.collect_list(F.struct("species", "reaction", F.col("r").cast("double").alias("r"), F.col("p").cast("double").alias("p"))).alias("cells"))
    if crn.complete:
        name = lambda c: F.array_sort(F.array_compact(F.array_distinct(F.col(f"cells.{c}")))).alias(c + "_list")
        return cells.select("network", name("species"), name("reaction"), "cells")
    names = lambda df, c: df.groupBy("network").agg(F.sort_array(F.collect_set(c)).alias(c + "_list"))
    own = names(crn.species, "species").join(names(crn.reactions, "reaction"), "network", "full").join(cells, "network", "left")
    full = lambda c: F.coalesce(c, F.array().cast(own.schema[c].dataType)).alias(c)
    return own.select("network", full("species_list"), full("reaction_list"), full("cells"))


def few(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most, so that Python objects of few networks are held at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def in_lists(rows: DataFrame, key: str, members: Column, most: int) -> DataFrame:
    """(key, members) of rows (network, key, ...): members, an aggregate, of those of equal key, in lists of about so many networks at most, by a
    hash of their names.
    """
    n = rows.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_n"))
    dealt = rows.join(n, rows[key].eqNullSafe(n[key])).drop(n[key]).groupBy(key, F.pmod(F.xxhash64("network"), F.col("_n")).alias("_part"))
    return dealt.agg(members.alias("members")).select(key, "members")


def from_nested(rows: DataFrame) -> Crn:
    """Tables of networks in rows."""
    name = lambda column, i: F.get(F.col(column), i)
    cells = rows.select("network", "species", "reactions", F.explode("cells").alias("x"))
    cells = cells.select("network", name("reactions", F.col("x.j")).alias("reaction"), name("species", F.col("x.s")).alias("species"), "x.r", "x.p").where("r <> 0 OR p <> 0")
    return Crn(cells, rows.select("network", F.explode("species").alias("species")), rows.select("network", F.explode("reactions").alias("reaction")))
