"""Merkle manifest of a table: one root for all rows, a proof for each row.

A row is a leaf, the SHA-256 of its fields. The leaves of a group, in the order of their key, are hashed pairwise level by
level until one node remains, the group's subroot; the subroots, in the order of their groups, are hashed in the same way
to the root. Every level is a written table whose rows hold the digests of their two children; proofs are then pushed from
the root down: a child joins its parent and puts its sibling before the proof that the parent inherited.

Defined results: a null field counts as "-", any other as its length in UTF-8 bytes, ":" and its text; null groups and null keys
come first; rows of one key are ordered by their leaves, and equal rows by their place in the table, which no digest shows;
a group of one row has its leaf as subroot, a table of one group its subroot as root; an empty table has no rows. Texts of
any length are hashed in one pass. Columns of the table can have any name: none but those named is carried.

Scale: texts are read once and never shuffled, only digests are. Positions come from a range sort, split within groups too,
so that one group may hold most rows; a level is half of the one below, so that all levels together are twice the
leaves. A proof is 33 bytes for each level. Nothing reaches the driver but the height of the tallest group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoichion.llm.keys import saved

#: Levels of at most so many nodes are worked on by one task each; more are shuffled.
FEW = 50_000

#: How a node stands to its sibling: it has none, the sibling is on the left, or on the right.
ALONE, LEFT, RIGHT = 0, 1, 2


def field_text(column: str | Column) -> Column:
    """A field as it is hashed."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of texts one after the other, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(column: str | Column) -> Column:
    return F.lower(F.hex(column))


def leaf(*columns: str | Column) -> Column:
    """The leaf of a row of these fields."""
    return digest(*(field_text(c) for c in columns))


@dataclass
class Manifest:
    """levels[k]: (g, pos, m, hash, l, r), the nodes of level k of each group, m of them, with the digests of their children;
    leaves have what was carried instead. nodes: the most rows that a level can have. groups: (g, subroot, root, proof).
    """

    levels: list[DataFrame]
    nodes: list[int]
    groups: DataFrame
    folder: str


def _few(level: DataFrame, nodes: int) -> DataFrame:
    """A level; a small one in one partition, which needs no shuffle."""
    return level.coalesce(1) if nodes <= FEW else level


def _placed(rows: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """rows with their position pos within g in the given order, and m, the number of rows of g."""
    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    # The upper bits of the number are the partition, the lower ones the place in it.
    ranged = saved(ranged.withColumn("_at", F.monotonically_increasing_id()), folder, name)
    part = F.shiftright("_at", 33)
    runs = ranged.groupBy("g", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("g")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("g", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("m"))
    placed = ranged.withColumn("_part", part).join(runs, ["g", "_part"])
    return placed.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _grown(leaves: DataFrame, folder: str) -> tuple[list[DataFrame], list[int]]:
    """All levels of leaves (g, pos, m, hash), each written, and the most nodes that each can have; groups of one node are
    complete and don't go on.
    """
    levels, at = [leaves], leaves
    seen = leaves.agg(F.max("m"), F.count("*"), F.count_if(F.col("pos") == 0)).first()
    tallest, nodes, groups = seen[0] or 0, [seen[1]], seen[2]
    while tallest > 1:
        side = lambda odd: F.max(F.when(F.col("pos").bitwiseAND(1) == odd, F.col("hash")))
        pairs = _few(at.where("m > 1"), nodes[-1]).groupBy("g", F.shiftright("pos", 1).alias("pos")).agg(F.max("m").alias("m"), side(0).alias("l"), side(1).alias("r"))
        above = digest(hexed("l"), F.coalesce(hexed("r"), F.lit("")))
        up = pairs.select("g", "pos", F.shiftright(F.col("m") + 1, 1).alias("m"), above.alias("hash"), "l", "r")
        at = saved(up, folder, f"level-{len(levels)}")
        levels.append(at)
        tallest = (tallest + 1) // 2
        nodes.append((nodes[-1] + groups) // 2)
    return levels, nodes


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(g, hash): the last node of each group."""
    out = None
    for level in levels:
        own = level.where("m = 1").select("g", "hash")
        out = own if out is None else out.unionByName(own)
    return out


def _step(pos: Column) -> Column:
    """The sibling of a node and its side, as the parent's row has them."""
    odd, l, r = pos.bitwiseAND(1) == 1, F.col("_pair.l"), F.col("_pair.r")
    side = F.when(odd, LEFT).when(r.isNull(), ALONE).otherwise(RIGHT)
    return F.struct(side.cast("tinyint").alias("side"), F.when(odd, l).otherwise(r).alias("digest"))


def _pushed(levels: list[DataFrame], nodes: list[int], tops: DataFrame, folder: str) -> DataFrame:
    """levels[0] with the proof of each node, tops (g, proof) being what the last node of each group inherits."""
    above: DataFrame | None = None
    tops = tops.select("g", "proof")
    for k in reversed(range(len(levels))):
        level, own = levels[k], [c for c in levels[k].columns if k == 0 or c not in ("m", "hash")]
        down = _few(level.where("m = 1").join(tops, "g"), nodes[k]).select(*own, "proof")
        if above is not None:
            parents = above.select("g", F.col("pos").alias("_pos"), F.struct("l", "r").alias("_pair"), F.col("proof").alias("_proof"))
            children = level.where("m > 1").withColumn("_pos", F.shiftright("pos", 1))
            met = _few(children, nodes[k]).join(_few(parents, nodes[k]), ["g", "_pos"])
            down = down.unionByName(met.withColumn("proof", F.concat(F.array(_step(F.col("pos"))), "_proof")).select(*own, "proof"))
        above = saved(down, folder, f"proofs-{k}") if k else down
    return above


def build(rows: DataFrame, folder: str) -> Manifest:
    """Manifest of rows (g, key, leaf, and columns that are carried): g is text or null. All levels are written below folder."""
    group = F.coalesce(F.concat(F.lit("="), F.col("g").cast("string")), F.lit("-"))
    # The place in the table parts equal rows, so that however many there are they needn't meet in one range.
    leaves = saved(rows.withColumn("g", group).withColumnRenamed("leaf", "hash").withColumn("_row", F.monotonically_increasing_id()), folder, "leaves")
    leaves = saved(_placed(leaves, ["key", "hash", "_row"], folder, "ordered").drop("_row"), folder, "level-0")
    levels, nodes = _grown(leaves, folder)
    subroots = saved(_tops(levels).withColumnsRenamed({"g": "name"}).withColumn("g", F.lit("")), folder, "subroots")
    top, many = _grown(saved(_placed(subroots, ["name"], folder, "groups"), folder, "groups-0"), f"{folder}/top")
    root = _tops(top).withColumn("proof", F.array().cast("array<struct<side:tinyint,digest:binary>>"))
    known = _pushed(top, many, root, f"{folder}/top").join(root.select("g", F.col("hash").alias("root")), "g")
    groups = known.select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "root", "proof")
    return Manifest(levels, nodes, saved(groups, folder, "roots"), folder)


def proofs(manifest: Manifest) -> DataFrame:
    """(key, hash, what was carried, subroot, root, proof): proof lists siblings from the leaf to the root."""
    rows = _pushed(manifest.levels, manifest.nodes, manifest.groups, manifest.folder)
    return rows.join(manifest.groups.select("g", "subroot", "root"), "g").drop("g", "pos", "m")


def siblings(proof: str = "proof") -> Column:
    """The digests of a proof one after the other, as hex text."""
    return F.array_join(F.transform(proof, lambda s: hexed(s["digest"])), "")


def folded(start: Column, proof: str = "proof") -> Column:
    """The root, as hex text, that follows from a leaf (as hex text) and a proof."""
    def up(at: Column, s: Column) -> Column:
        other = hexed(s["digest"])
        return F.sha2(F.when(s["side"] == ALONE, at).when(s["side"] == LEFT, F.concat(other, at)).otherwise(F.concat(at, other)), 256)

    return F.aggregate(proof, start, up)
