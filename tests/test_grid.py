"""All pairs of names are made from lists, within tasks; networks are gathered once for both sides."""

import pytest
from pyspark.sql import functions as F

from stoichion.model import crn_view, nested
from stoichion.operators import search, shapes
from stoichion.operators.projection import sizes
from stoichion.plans import finder, queries
from tests.test_matching import random_rows, table


@pytest.fixture(scope="module")
def sides(spark):
    times = lambda rows, n: [dict(r, network=f"{r['network']}-{i}") for r in rows for i in range(n)]
    return table(spark, times(random_rows(1, 6, "a", 3, 3), 5)), table(spark, times(random_rows(2, 6, "b", 5, 6, 3), 4))


@pytest.fixture(autouse=True)
def short_lists(monkeypatch):
    monkeypatch.setattr(search, "LIST", 2)
    monkeypatch.setattr(search, "GRID", 5)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_grid_is_that_of_a_cross_join(spark, sides):
    found, *members = search.kind_counts(*sides)
    name = lambda df, c: df.select(F.col("network").alias(c))
    want = name(sides[0], "reference").crossJoin(name(sides[1], "target")).join(search.expanded(found, *members), ["reference", "target"], "left").select("reference", "target", *found.columns[2:])
    got = search.every_pair(found, *members)
    assert rows_of(got.select(*want.columns)) == rows_of(want) and got.count() == 30 * 24 and got.where("n_pairs > 0").count() > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    # Above the join of lists nothing moves.
    assert above.count("Generate explode") == 3 and "Repartition" not in above and "Aggregate" not in above


def test_phases_are_those_of_kinds(spark, sides, monkeypatch):
    asked, step = [], search.Catalogues.step
    monkeypatch.setattr(search.Catalogues, "step", lambda self, frontier, *x, **y: (asked.append(frontier.count()), step(self, frontier, *x, **y))[1])
    want = rows_of(search.mapping_counts(*sides, misses=True).select("reference", "target", "n_pairs", "is_truncated"))
    asked.clear()
    assert rows_of(finder.two_phase(*sides, first=2)) == want
    assert asked[0] <= 36 and len(asked) > 1


def test_networks_are_gathered_once(spark, monkeypatch):
    c, asked = crn_view(spark, "/root/testdata/sf0.001"), []
    want = [rows_of(nested(x).withColumn("cells", F.sort_array("cells"))) for x in queries.halves(c)]
    monkeypatch.setattr(queries, "nested", lambda x: (asked.append(1), nested(x))[1])
    got = queries.in_rows(c)
    assert [rows_of(x.withColumn("cells", F.sort_array("cells"))) for x in got] == want and len(asked) == 1
    assert sum(x.count() for x in got) == sizes(c).count() and all(want)


def test_kinds_meet_by_a_hash_before_cells(spark, sides, monkeypatch):
    plans = []
    monkeypatch.setattr(shapes, "saved", lambda df, *_: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])
    one, members = shapes.kinds(shapes.compact(sides[0], "strong"), "", "x")
    assert "Aggregate [_hash#" in plans[0] and "_hash#" in plans[1].split("Join Inner")[1].split("\n")[0]
    assert one.columns == ["network", "n_species", "n_reactions", "cells"] and members.count() == 30 and one.count() <= 6
