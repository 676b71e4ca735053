"""What keeps work and texts within bounds as tables grow, with the results of the plain way."""

import random
import re

from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG
from stoichion.model import Crn, few, from_cells, from_nested, gathered, nested
from stoichion.operators import accessors, cluster, nullmodel, refinement, search
from stoichion.operators.projection import edge_list_text, sizes
from stoichion.plans import finder
from stoichion.sources import serial
from tests.test_matching import random_rows, table


def copies(spark, n=3):
    rows = random_rows(3, 6, "a", 3, 4)
    return table(spark, [dict(r, network=f"{r['network']}-{i}") for r in rows for i in range(n)]), rows


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_cells_tell_what_the_three_tables_tell(spark):
    cells = from_nested(copies(spark)[0]).cells
    short = from_cells(cells)
    plain = Crn(cells, cells.select("network", "species").distinct(), cells.select("network", "reaction").distinct())
    ordered = lambda x: nested(x).withColumn("cells", F.sort_array("cells"))
    assert rows_of(ordered(short)) == rows_of(ordered(plain))
    assert rows_of(sizes(short)) == rows_of(sizes(plain))
    for identity in ("strong", "weak"):
        assert rows_of(edge_list_text(short, identity)) == rows_of(edge_list_text(plain, identity))
    assert "Join" not in gathered(short)._jdf.queryExecution().toString()
    assert edge_list_text(short)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_one_of_equal_networks_is_coloured_and_searched(spark, monkeypatch):
    every, rows = copies(spark)
    asked, colour = [], refinement.coloured_cells
    monkeypatch.setattr(refinement, "coloured_cells", lambda x: (asked.append(x.count()), colour(x))[1])
    got = {r["network"]: r["cluster"] for r in cluster.clusters(every).collect()}
    assert asked and max(asked) <= len(rows)
    one = {r["network"]: r["cluster"] for r in cluster.clusters(table(spark, rows)).collect()}
    assert got == {f"{n}-{i}": f"{c}-0" for n, c in one.items() for i in range(3)}
    key = {r["network"]: r["key"] for r in refinement.refined(every).collect()}
    assert len(key) == 3 * len(rows) and all(key[f"{r['network']}-0"] == key[f"{r['network']}-2"] for r in rows)
    none = cluster.clusters(every, budget=0, exact=False).where("is_indeterminate").collect()
    assert all(r["cluster"] == r["network"] for r in none)


def test_groups_of_copies_have_their_own_names(spark):
    row = {"network": "x", "species": ["A", "B"], "reactions": ["R"], "cells": [{"s": s, "j": 0, "r": 1.0, "p": 0.0} for s in (0, 1)]}
    got = cluster.automorphism_groups(table(spark, [row, row | {"network": "y", "species": ["C", "D"]}])).collect()
    assert {r["network"]: (r["group_size"], r["species_orbits"]) for r in got} == {"x": ("2", [["A", "B"]]), "y": ("2", [["C", "D"]])}


def test_matrices_of_copies_are_compared_once(spark, monkeypatch):
    every, rows = copies(spark)
    pairs = every.select(F.col("network").alias("reference"), F.col("network").alias("target"), F.transform("species", lambda _, i: i).alias("species"), F.transform("reactions", lambda _, i: i).alias("reactions"))
    wrong = pairs.withColumn("species", F.reverse("species")).where(F.size("species") > 1)
    asked, agreeing = [], search._agreeing
    monkeypatch.setattr(search, "_agreeing", lambda x, *y: (asked.append(x.count()), agreeing(x, *y))[1])
    got = search.checked_pairs(pairs.unionByName(wrong), every, every).collect()
    assert asked[0] <= 2 * len(rows)
    assert {r["reference"] for r in got if r["species"] == sorted(r["species"])} == {r["network"] for r in every.collect()}


def test_collections_and_runners_in_several_texts(spark):
    every, rows = copies(spark)
    at = every.withColumn("n", F.lit(1))
    one, several = serial.collection_to_json(at, "n"), serial.collection_to_json(at, "n", 8)
    assert one.count() == 1 and several.count() > 2
    whole = rows_of(serial.collection_from_json(one))
    assert rows_of(serial.collection_from_json(several)) == whole and len(whole) == 3 * sum(bool(r["species"]) for r in rows)
    assert rows_of(serial.collection_from_json(serial.collection_to_json(every, None, 8)).drop("directory")) == rows_of(serial.collection_from_json(one).drop("directory"))
    lines = spark.range(0, 100, 1, 7).select((F.col("id") * 37 % 101).alias("number"), F.concat(F.lit("e"), F.col("id") * 37 % 101).alias("value"))
    one, several = (serial.runner_to_json(lines, 3, 2, True, STRONG, most) for most in (None, 8))
    assert one.count() == 1 and several.count() >= 13
    assert rows_of(serial.runner_from_json(several)) == rows_of(serial.runner_from_json(one))


def test_lines_of_a_collection_come_without_its_text(spark):
    back = serial.collection_from_json(spark.createDataFrame([("{}",)], "value string"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Generate explode\(\S+\), \[directory#\d+\]", plan), plan


def test_pending_by_parts_moves_no_pairs(spark):
    a, b = (spark.range(n).select(F.col("id").alias("network"), (F.col("id") % 4).alias("part")) for n in (30, 20))
    done = spark.createDataFrame([(i, j) for i in range(4) for j in range(4) if (i + j) % 2 == 0], "reference_part long, target_part long")
    got = {(r["reference"], r["target"]) for r in finder.pending_of_parts(a, b, done).collect()}
    assert got == {(x, y) for x in range(30) for y in range(20) if (x + y) % 2}


def test_sizes_by_key_need_no_members(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c"), (6, "c")], "network long, key string")
    lead = keys.join(keys.groupBy("key").agg(F.min("network").alias("cluster")), "key").select("cluster", "network")
    for least in (None, 2):
        assert rows_of(accessors.key_sizes(keys, least)) == rows_of(accessors.clusters_by_size(lead, least).select("cluster", "n"))


def test_switches_draw_what_sample_draws():
    def plain(edges, steps, rng):
        edges, taken = list(edges), {(s, j) for s, j, _ in edges}
        for _ in range(steps * len(edges) if len(edges) > 1 else 0):
            a, b = rng.sample(range(len(edges)), 2)
            (s, j, x), (t, k, y) = edges[a], edges[b]
            if s != t and j != k and (t, j) not in taken and (s, k) not in taken:
                taken = (taken - {(s, j), (t, k)}) | {(t, j), (s, k)}
                edges[a], edges[b] = (t, j, x), (s, k, y)
        return edges

    for n in (1, 2, 5, 21, 22, 60):
        edges = [(i % 7, i // 3, 1.0 + i % 2) for i in range(n)]
        assert nullmodel.switched(edges, 20, random.Random(n)) == plain(edges, 20, random.Random(n))


def test_few_rows_at_a_time():
    import pyarrow as pa

    parts = list(few([pa.RecordBatch.from_pydict({"a": list(range(600))})]))
    assert [p.num_rows for p in parts] == [256, 256, 88] and sum((p.column(0).to_pylist() for p in parts), []) == list(range(600))
