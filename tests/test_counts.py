"""What class counts tell is worked out for lists of networks of equal counts; pairs of names are made from the lists."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stoichion.model import Crn, from_cells, from_nested
from stoichion.operators import compat, counting, features
from stoichion.operators.features import REACTION
from stoichion.operators.projection import reaction_classes
from tests.test_matching import random_rows, table


@pytest.fixture(scope="module")
def sides(spark):
    """More copies than a list holds."""
    times = lambda rows, n: [dict(r, network=f"{r['network']}-{i}") for r in rows for i in range(n)]
    return tuple(from_nested(table(spark, x)) for x in (times(random_rows(3, 6, "a", 3, 4), 5), times(random_rows(4, 6, "b", 5, 9, 3), 3)))


@pytest.fixture(autouse=True)
def short_lists(monkeypatch):
    monkeypatch.setattr(counting, "MEMBERS", 2)


def listed(sides):
    return compat.candidates(*sides, REACTION, features.chosen(REACTION, "z"))


@pytest.mark.parametrize("most", [0.0, 0.7, 1.5, 30.0])
def test_cuts_by_counts_are_those_of_lists(spark, sides, most):
    found, node = listed(sides), ["reference", "target", "ref_node"]
    n = found.groupBy(*node).agg(F.count("*").alias("n_before"))
    kept = counting.pruned(found, most).groupBy(*node).agg(F.count("*").alias("n_after"), F.first("is_changed").alias("is_changed"))
    want = sorted(map(str, n.join(kept, node).select(*node, "n_before", "n_after", "is_changed").collect()))
    got = counting.class_pruned(*sides, most)
    assert sorted(map(str, got.collect())) == want and len(want) > 100
    assert "tgt_node" not in got._jdf.queryExecution().toString()


def test_choices_by_counts_are_those_of_classes(spark, sides):
    def counts(crn):
        out = {}
        for r in reaction_classes(crn).collect():
            out.setdefault(r["network"], Counter())[r["class"]] += 1
        return out

    def ways(a, b):
        n = 1
        for k, x in a.items():
            for i in range(x):
                n *= max(b[k] - i, 0)
        return n

    own, far = (counts(x) for x in sides)
    want = {(a, b): n for a, x in own.items() for b, y in far.items() if (n := ways(x, y))}
    got = counting.class_choices(*sides)
    assert {(r["reference"], r["target"]): r["n"] for r in got.collect()} == want and want
    assert got.count() == len(want)


@pytest.mark.parametrize("count", [counting.class_choices, counting.class_assignments, lambda a, b: counting.class_pruned(a, b, 3.0)])
def test_pairs_of_names_are_made_without_moving(spark, sides, count):
    plan = count(*sides)._jdf.queryExecution().optimizedPlan().toString()
    # Lists meet, and nothing is joined or grouped above the pairs that are made from them.
    assert plan.count("Generate") == 2
    above = plan[: plan.rindex("Generate")]
    assert "Join" not in above and "Aggregate" not in above


def test_classes_where_all_nodes_have_cells_need_no_join(spark, sides):
    cells = sides[1].cells
    short, plain = from_cells(cells), Crn(cells, cells.select("network", "species").distinct(), cells.select("network", "reaction").distinct())
    rows = lambda x: sorted(map(str, reaction_classes(x).collect()))
    assert rows(short) == rows(plain) and "Join" not in reaction_classes(short)._jdf.queryExecution().toString()
