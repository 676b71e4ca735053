"""Structural identity: canonical forms, buckets and clusters.

Networks are identical when one is the other with species and reactions renamed. Colours of all nodes are refined over the
catalogue first (`refinement`), which settles most. Networks that share their colours with others and have several nodes of one
colour get a canonical form, each by itself: while a colour has several nodes, each in turn is singled out, and the least of
the forms found is taken. Identity is then equality of forms, so clusters are a groupBy, without comparing members. Networks
whose form takes more than `budget` steps are compared, those of equal colours with one of them at a time, by a search that is
dealt out until it ends. All this is done for one network of those that are equal by position, which get its cluster and symmetries.

The same tree gives the automorphisms of a network: two nodes are in one orbit if singling out either leads to equal forms, and
the group's size is the product of such orbits while one node after another is fixed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG
from stoichion.operators.refinement import refined
from stoichion.model import few
from stoichion.operators.search import Net, identical
from stoichion.operators.shapes import compact, kinds
from stoichion.store import saved, workspace

BUDGET = 20_000


class _Canonical:
    def __init__(self, net: Net, budget: int) -> None:
        self.n, self.m, self.left = len(net.species), len(net.reactions), budget
        self.near: list[list[tuple[tuple, int]]] = [[] for _ in range(self.n + self.m)]
        for j, cells in enumerate(net.cells):
            for s, c in cells.items():
                self.near[s].append((c, self.n + j))
                self.near[self.n + j].append((c, s))
        self.cells = net.cells
        self.best: tuple | None = None

    def refine(self, colour: list[int]) -> list[int]:
        while True:
            key = [(c, sorted((e, colour[v]) for e, v in self.near[i])) for i, c in enumerate(colour)]
            rank = {k: i for i, k in enumerate(sorted({(k[0], tuple(k[1])) for k in key}))}
            new = [rank[k[0], tuple(k[1])] for k in key]
            if len(set(new)) == len(set(colour)):
                return new
            colour = new

    def walk(self, colour: list[int]) -> None:
        if self.left <= 0:
            return
        self.left -= 1
        colour = self.refine(colour)
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(colour):
            groups.setdefault(c, []).append(i)
        open_ = [(len(v), c) for c, v in groups.items() if len(v) > 1]
        if not open_:
            order = {i: c for i, c in enumerate(colour)}
            form = tuple(sorted((order[self.n + j], order[s], *c) for j, cells in enumerate(self.cells) for s, c in cells.items()))
            self.best = form if self.best is None or form < self.best else self.best
            return
        members = groups[min(open_)[1]]
        twins: set[tuple] = set()
        for i in members:
            own = tuple(sorted(self.near[i]))
            if own in twins:  # the same cells in the same places: either leads to the same form
                continue
            twins.add(own)
            split = [2 * c for c in colour]
            split[i] -= 1
            self.walk(split)


def canonical_form(net: Net, budget: int = BUDGET) -> tuple[str, bool]:
    """Text that is equal for identical networks only, and whether it was found within the budget."""
    work = _Canonical(net, budget)
    work.walk([0] * work.n + [1] * work.m)
    done = work.left > 0 and work.best is not None
    body = ";".join(",".join(f"{x:g}" for x in row) for row in work.best) if work.best is not None else ""
    return f"{work.n}|{work.m}|{body}", done


def canonical_forms(networks: DataFrame, identity: str = STRONG, budget: int = BUDGET) -> DataFrame:
    """(network, form, is_indeterminate, seconds) of networks in rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = []
            for x in batch.to_pylist():
                began = time.perf_counter()
                form, done = canonical_form(Net.of(x, identity), budget)
                rows.append((x["network"], form if done else f"{form}|{x['network']}", not done, time.perf_counter() - began))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["network", "form", "is_indeterminate", "seconds"])

    return networks.select("network", "species", "reactions", "cells").mapInArrow(run, "network string, form string, is_indeterminate boolean, seconds double")


def clusters(networks: DataFrame, identity: str = STRONG, budget: int = BUDGET, exact: bool = True) -> DataFrame:
    """(cluster, network, is_indeterminate): cluster is the least name of the networks identical to one. With exact unset, networks
    that need more than the budget stay alone and are marked.
    """
    folder = workspace(networks.sparkSession, "clusters")
    one, members = kinds(saved(compact(networks, identity), folder, "rows"), folder, "kinds")
    every = saved(networks.join(one.select("network"), "network", "left_semi"), folder, "one-of-each")
    found = _clusters(every, identity, budget, exact, folder).withColumnRenamed("network", "kind")
    # What is undecided stays alone.
    cluster = F.when(F.col("is_indeterminate"), F.col("network")).otherwise(F.col("cluster"))
    return members.join(found, "kind").select(cluster.alias("cluster"), "network", "is_indeterminate")


def _clusters(networks: DataFrame, identity: str, budget: int, exact: bool, folder: str) -> DataFrame:
    """clusters() of networks none of which are equal by position."""
    colours = saved(refined(networks, identity), folder, "colours")
    shared = colours.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    hard = colours.where("NOT is_discrete").join(shared, "key", "left_semi")
    forms = saved(canonical_forms(networks.join(hard.select("network"), "network", "left_semi"), identity, budget).select("network", "form", "is_indeterminate"), folder, "forms")
    own = colours.join(forms, "network", "left")
    rows = own.select("network", F.sha2(F.concat_ws("|", "key", F.coalesce("form", F.lit(""))), 256).alias("class"), F.coalesce("is_indeterminate", F.lit(False)).alias("is_indeterminate"))
    if exact:
        met = _compared(colours.join(forms.where("is_indeterminate"), "network", "left_semi").select("network", "key"), networks, identity, folder)
        rows = rows.join(met, "network", "left").select("network", F.coalesce("leader", "class").alias("class"), F.lit(False).alias("is_indeterminate"))
    leaders = rows.groupBy("class").agg(F.min("network").alias("cluster"))
    return rows.join(leaders, "class").select("cluster", "network", "is_indeterminate")


def _compared(left: DataFrame, networks: DataFrame, identity: str, folder: str) -> DataFrame:
    """(network, leader) of networks with their key: in each round the least of those left of a key leads, and those identical
    to it leave; as many rounds as a key has classes.
    """
    out, number = left.select("network", F.lit(None).cast("string").alias("leader")).limit(0), 0
    while not left.isEmpty():
        led = saved(left.join(left.groupBy("key").agg(F.min("network").alias("leader")), "key"), folder, f"led-{number}")
        pairs = led.where("network <> leader").select(F.col("leader").alias("reference"), F.col("network").alias("target"))
        same = identical(pairs, networks, identity).select(F.col("target").alias("network"), F.col("reference").alias("leader"))
        done = saved(same.unionByName(led.where("network = leader").select("network", "leader")), folder, f"done-{number}")
        out, left, number = out.unionByName(done), saved(led.select("network", "key").join(done, "network", "left_anti"), folder, f"left-{number}"), number + 1
    return out


def _form_from(work: _Canonical, colour: list[int]) -> tuple | None:
    work.best = None
    work.walk(colour)
    return work.best if work.left > 0 else None


def _orbits(work: _Canonical, colour: list[int], members: list[int]) -> dict[tuple | None, list[int]]:
    """Nodes of one colour by the form that singling each out leads to."""
    out: dict[tuple | None, list[int]] = {}
    for i in members:
        single = [2 * c for c in colour]
        single[i] -= 1
        out.setdefault(_form_from(work, single), []).append(i)
    return out


def automorphisms(net: Net, budget: int = BUDGET) -> tuple[int | None, list[list[int]]]:
    """Size of the group of renamings that leave a network as it is, and the orbits of more than one node (species by number, then
    reactions from the number of species on); None and no orbits beyond the budget.
    """
    work = _Canonical(net, budget)
    several = lambda colour: [v for v in _classes(colour).values() if len(v) > 1]
    colour = work.refine([0] * work.n + [1] * work.m)
    orbits = [sorted(o) for v in several(colour) for o in _orbits(work, colour, v).values() if len(o) > 1]
    size = 1
    while open_ := several(colour):
        members = min(open_, key=lambda v: (len(v), v))
        found = _orbits(work, colour, members)
        if None in found:
            break
        size *= next(len(o) for o in found.values() if members[0] in o)
        single = [2 * c for c in colour]
        single[members[0]] -= 1
        colour = work.refine(single)
    return (None, []) if work.left <= 0 else (size, sorted(orbits))


def _classes(colour: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, c in enumerate(colour):
        out.setdefault(c, []).append(i)
    return out


def automorphism_groups(networks: DataFrame, identity: str = STRONG, budget: int = BUDGET) -> DataFrame:
    """(network, group_size, species_orbits, reaction_orbits) of networks in rows: the size as text, as it may be beyond any
    number type, null beyond the budget; orbits of more than one node, as names. Species in no reaction count as one orbit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("kind", pa.string()), ("group_size", pa.string()), ("s", pa.list_(pa.list_(pa.int32()))), ("j", pa.list_(pa.list_(pa.int32())))])
        for batch in few(batches):
            rows = []
            for x in batch.to_pylist():
                n = x["n_species"]
                size, orbits = automorphisms(Net.packed(x["network"], n, x["n_reactions"], tuple([c[k] for c in x["cells"]] for k in "sjrp")), budget)
                rows.append({
                    "kind": x["network"], "group_size": None if size is None else str(size),
                    "s": [o for o in orbits if o[0] < n], "j": [[i - n for i in o] for o in orbits if o[0] >= n],
                })
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    folder = workspace(networks.sparkSession, "automorphisms")
    one, members = kinds(saved(compact(networks, identity), folder, "rows"), folder, "kinds")
    # By number, as few rows may be much work.
    parts = max(int(networks.sparkSession.conf.get("spark.sql.shuffle.partitions")), networks.sparkSession.sparkContext.defaultParallelism)
    found = saved(one.repartition(parts, "network").mapInArrow(run, "kind string, group_size string, s array<array<int>>, j array<array<int>>"), folder, "found")
    named = lambda orbits, names: F.transform(orbits, lambda o: F.transform(o, lambda i: F.get(F.col(names), i)))
    at = networks.select("network", "species", "reactions").join(members, "network").join(found, "kind")
    return at.select("network", "group_size", named("s", "species").alias("species_orbits"), named("j", "reactions").alias("reaction_orbits"))


def cluster_table(found: DataFrame) -> DataFrame:
    """(cluster, n, n_indeterminate, networks): a row for each cluster."""
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("is_indeterminate").alias("n_indeterminate"), F.sort_array(F.collect_list("network")).alias("networks"))


def subset_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cluster, network): networks of a that b doesn't put together with the least of their cluster of a."""
    at = a.join(b.select("network", F.col("cluster").alias("_own")), "network", "left")
    lead = a.where("network = cluster").join(b.select("network", F.col("cluster").alias("_lead")), "network", "left").select("cluster", "_lead")
    return at.join(lead, "cluster", "left").where("NOT _own <=> _lead OR _own IS NULL").select("cluster", "network")
