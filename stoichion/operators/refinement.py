"""Colours of nodes by their neighbours, over whole catalogues at once.

All species have one colour and all reactions another; in each round a node's colour becomes the hash of its own and of its
cells with their neighbours' colours, until no network gains colours. Networks with other colours are not identical. Where every
node in a cell has a colour of its own, equal colours settle identity and no search is needed. Rounds are windows of cells by
network and node, for which cells move once, by network; as many are needed as colours take to spread, at most the nodes of a network.
Networks that are equal by position are one kind and coloured once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG
from stoichion.operators.shapes import compact, kinds
from stoichion.store import saved, workspace


def _cells(rows: DataFrame) -> DataFrame:
    """(network, s, j, r, p) of compact() networks."""
    return rows.select("network", F.explode("cells").alias("c")).select("network", "c.s", "c.j", "c.r", "c.p")


def _recoloured(node: str, other: str) -> Column:
    """The next colour of a cell's node, from cells with the colours c_s and c_j."""
    seen = F.sort_array(F.collect_list(F.struct("r", "p", f"c_{other}")).over(Window.partitionBy("network", node)))
    return F.xxhash64(f"c_{node}", seen)


def coloured_cells(rows: DataFrame) -> DataFrame:
    """(network, s, j, r, p, c_s, c_j): the cells of compact() networks with the stable colours of their nodes."""
    folder = workspace(rows.sparkSession, "colours")
    cells = saved(_cells(rows).withColumns({"c_s": F.lit(0).cast("long"), "c_j": F.lit(1).cast("long")}), folder, "round-0")
    before, number = None, 0
    while True:
        colours = cells.select("network", F.explode(F.array("c_s", "c_j")).alias("c")).distinct().count()
        if colours == before:
            return cells
        before, number = colours, number + 1
        cells = saved(cells.repartition("network").withColumns({"c_s": _recoloured("s", "j"), "c_j": _recoloured("j", "s")}), folder, f"round-{number}")


def refined(networks: DataFrame, identity: str = STRONG) -> DataFrame:
    """(network, key, is_discrete) of networks in rows: identical networks have one key; those that are discrete are identical if they have."""
    folder = workspace(networks.sparkSession, "refined")
    rows, members = kinds(saved(compact(networks, identity), folder, "rows"), folder, "kinds")
    cells = coloured_cells(rows)
    own = cells.groupBy("network").agg(
        F.md5(F.to_json(F.sort_array(F.collect_list(F.struct("c_s", "c_j", "r", "p"))))).alias("body"),
        ((F.countDistinct("s") == F.countDistinct("c_s")) & (F.countDistinct("j") == F.countDistinct("c_j"))).alias("is_discrete"),
    )
    key = F.concat_ws("|", "n_species", "n_reactions", F.coalesce("body", F.lit("")))
    found = rows.join(own, "network", "left").select(F.col("network").alias("kind"), key.alias("key"), F.coalesce("is_discrete", F.lit(True)).alias("is_discrete"))
    return members.join(found, "kind").select("network", "key", "is_discrete")
