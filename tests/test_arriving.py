"""Clusters of arriving models, and the null model of given networks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG
from stoichion.operators import nullmodel, search
from stoichion.operators.search import Net, Search
from stoichion.sources import files
from stoichion.streaming.arriving import cluster_stream
from tests.test_matching import random_rows, shuffled, table


def test_clusters_of_arriving_models(spark, tmp_path):
    """Three runs of one stream: later models join the clusters of earlier runs."""
    rng = random.Random(1)
    base = random_rows(11, 10, "m", 4, 4)[1:]  # JSON lines leave networks without species out
    rows = [shuffled(rng, r, f"{r['network']}-{k}") for k in range(3) for r in base]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(3):
        part = rows[9 * k : 9 * k + 9]
        files.write_json_lines(table(spark, part), src, "append")
        cluster_stream(spark, src, out, ck).awaitTermination()
    got = {x["network"]: x for x in spark.read.parquet(out).collect()}
    assert len(got) == len(rows)
    nets = {r["network"]: Net.of(r, STRONG) for r in rows}
    for a, b in itertools.combinations(sorted(nets), 2):
        same = (not nets[a].reactions and not nets[b].reactions and len(nets[a].species) == len(nets[b].species)) or Search(nets[a], nets[b], subset=False).summary()[0] > 0
        assert (got[a]["cluster"] == got[b]["cluster"]) == same
    assert all(x["is_new"] == (x["cluster"] == x["network"]) for x in got.values()) and all(x["cluster"].endswith("-0") for x in got.values())


def sides_of(row):
    cells = [c.asDict() if hasattr(c, "asDict") else c for c in row["cells"]]
    count = lambda key: sorted((side, c[key], tuple(sorted(d[side] for d in cells if d[key] == c[key] and d[side]))) for c in cells for side in "rp" if c[side])
    return count("j"), sorted((s, k, len(v)) for s, k, v in count("s"))


def test_null_model_keeps_degrees_and_differs(spark):
    rows = random_rows(12, 8, "n", 6, 8, 3)
    got = nullmodel.samples(table(spark, rows), 5).collect()
    again = nullmodel.samples(table(spark, rows).repartition(3), 5).collect()
    assert len(got) == 40 and sorted(map(str, got)) == sorted(map(str, again))
    own = {r["network"]: r for r in rows}
    assert all(sides_of(x) == sides_of(own[x["original"]]) for x in got)
    cells = lambda r: {(c["s"], c["j"], c["r"], c["p"]) for c in r["cells"]}
    assert sum(cells(x) != cells(own[x["original"]]) for x in got) > 15


@pytest.mark.parametrize("budget", [None, 100_000])
def test_significance_counts_samples_that_fit(spark, budget):
    refs, tgts = random_rows(13, 8, "a", 3, 3), random_rows(14, 8, "b", 5, 6, 3)
    a, b = table(spark, refs), table(spark, tgts)
    pairs = search.mapping_counts(a, b).select("reference", "target").unionByName(spark.createDataFrame([("a0", "b2"), ("a3", "b0")], "reference string, target string")).distinct()
    got = {(x["reference"], x["target"]): x for x in nullmodel.significance(pairs, a, b, 6, budget=budget).collect()}
    drawn = {}
    for x in nullmodel.samples(b, 6).collect():
        drawn.setdefault(x["original"], []).append(Net.of(x.asDict(recursive=True), STRONG))
    own = {r["network"]: Net.of(r, STRONG) for r in refs}
    assert set(got) == {tuple(x) for x in pairs.collect()}
    for (ref, tgt), x in got.items():
        n = sum(Search(own[ref], t).summary()[0] > 0 for t in drawn[tgt])
        assert x["n_found"] == n and x["p"] == n / 6 and x["n_samples"] == 6 and not x["n_truncated"]
    assert any(0 < x["n_found"] < 6 for x in got.values()) or any(x["n_found"] == 0 for x in got.values())


def test_significance_of_nothing(spark):
    empty = table(spark, [])
    assert nullmodel.significance(spark.createDataFrame([], "reference string, target string"), empty, empty, 3).count() == 0
    assert nullmodel.samples(empty, 3).agg(F.count("*")).first()[0] == 0
