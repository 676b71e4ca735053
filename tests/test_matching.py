"""The search by index against brute force: which pairs are searched, what is left open, what propagation keeps, counts, cuts, symmetries."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG, WEAK
from stoichion.operators import cluster, counting, propagation, refinement, search, shapes
from stoichion.operators.search import Net, Search
from stoichion.plans import finder
from stoichion.sources import files

SIDES = [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def random_rows(seed, count, prefix, species, reactions, cells=2):
    """Networks in rows; the first has neither species nor reactions, the second a reaction without cells."""
    rng, rows = random.Random(seed), []
    for n in range(count):
        s, m = (0, 0) if n == 0 else (rng.randint(1, species), rng.randint(1, reactions))
        own = [] if n == 1 else [{"s": i, "j": j, "r": x[0], "p": x[1]} for j in range(m) for i in rng.sample(range(s), min(s, rng.randint(1, cells))) for x in [rng.choice(SIDES)]]
        rows.append({"network": f"{prefix}{n}", "species": [f"s{i}" for i in range(s)], "reactions": [f"r{j}" for j in range(m)], "cells": own})
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, files.NESTED)


@pytest.fixture(scope="module")
def catalogue(spark):
    return random_rows(1, 12, "a", 3, 3), random_rows(2, 12, "b", 5, 6, 3)


@pytest.mark.parametrize("identity", [STRONG, WEAK])
@pytest.mark.parametrize("subset", [True, False])
def test_index_loses_no_pair(spark, catalogue, identity, subset):
    refs, tgts = catalogue
    tgts = tgts + [dict(r, network=f"copy-{r['network']}") for r in refs]
    sides = search.catalogues(table(spark, refs), table(spark, tgts), identity, subset)
    kept = {(x["reference"], x["target"]) for x in sides.start().collect()}
    hits = {(a["network"], b["network"]) for a in refs for b in tgts if Search(Net.of(a, identity), Net.of(b, identity), subset).summary()[0]}
    assert hits <= kept and len(kept) < len(refs) * len(tgts)
    got = {(x["reference"], x["target"]): x["n_pairs"] for x in search.mapping_counts(table(spark, refs), table(spark, tgts), identity, subset).collect()}
    assert got == {k: v for a in refs for b in tgts for k, v in [((a["network"], b["network"]), Search(Net.of(a, identity), Net.of(b, identity), subset).summary()[0])] if v}


def test_what_a_budget_leaves_open_goes_on_to_the_exact_count(spark):
    chain = lambda name, n: {"network": name, "species": [f"s{i}" for i in range(n + 1)], "reactions": [f"r{i}" for i in range(n)], "cells": [{"s": i + d, "j": i, "r": 1.0 - d, "p": float(d)} for i in range(n) for d in (0, 1)]}
    star = lambda name, n: {"network": name, "species": [f"s{i}" for i in range(2 * n)], "reactions": [f"r{i}" for i in range(n)], "cells": [{"s": 2 * i + d, "j": i, "r": 1.0 - d, "p": float(d)} for i in range(n) for d in (0, 1)]}
    refs, tgts = [chain("c3", 3), star("p3", 3)], [chain("c9", 9), star("p7", 7)]
    sides = search.catalogues(table(spark, refs), table(spark, tgts), STRONG)
    left, total, rounds = sides.start(), {}, 0
    while not left.isEmpty():
        step = sides.step(left, 20).cache()
        for x in step.where("n_pairs > 0").collect():
            total[x["reference"], x["target"]] = total.get((x["reference"], x["target"]), 0) + x["n_pairs"]
        left, rounds = search.frontier_of(step).cache(), rounds + 1
    want = {(a["network"], b["network"]): Search(Net.of(a, STRONG), Net.of(b, STRONG)).summary()[0] for a in refs for b in tgts}
    assert total == {k: v for k, v in want.items() if v} and rounds > 2 and want["p3", "p7"] == 210
    cut = {(x["reference"], x["target"]): x["is_truncated"] for x in search.mapping_counts(table(spark, refs), table(spark, tgts), budget=20).collect()}
    assert cut["p3", "p7"]
    both = {(x["reference"], x["target"]): x for x in finder.two_phase(table(spark, refs), table(spark, tgts), first=20).collect()}
    assert {k: x["n_pairs"] for k, x in both.items()} == want and not any(x["is_truncated"] for x in both.values())
    part = {(x["reference"], x["target"]): x for x in finder.two_phase(table(spark, refs), table(spark, tgts), first=5, second=2).collect()}
    assert part["p3", "p7"]["is_truncated"] and part["p3", "p7"]["n_pairs"] < 210


def test_listed_mappings_are_all_of_them(spark, catalogue):
    refs, tgts = catalogue
    got = sorted((x["reference"], x["target"], tuple(x["species"]), tuple(x["reactions"])) for x in search.mapping_pairs(table(spark, refs), table(spark, tgts)).collect())
    assert got == sorted((a["network"], b["network"], tuple(s), tuple(j)) for a in refs for b in tgts for s, j in Search(Net.of(a, STRONG), Net.of(b, STRONG)).pairs())


def test_misses_are_counts(spark, catalogue):
    refs, tgts = (table(spark, x) for x in catalogue)
    found = search.mapping_counts(refs, tgts)
    n = {}
    for x in found.collect():
        n[x["reference"]] = n.get(x["reference"], 0) + 1
    rows = search.misses(found, refs, tgts).collect()
    assert len(rows) == 12 and all(x["n_found"] == n.get(x["reference"], 0) and x["n_found"] + x["n_missed"] == 12 and not x["n_truncated"] for x in rows)


def test_propagation_keeps_every_mapping_and_reaches_its_fixed_point(spark, catalogue):
    refs, tgts = catalogue
    a, b = (shapes.compact(table(spark, x), STRONG) for x in (refs, tgts))
    reactions, species = propagation.propagated(a, b)
    left = lambda df, *c: {tuple(x) for x in df.select("reference", "target", *c).collect()}
    got_r, got_s = left(reactions, "i", "k"), left(species, "s", "t")
    before = left(propagation.start(a, b, shapes.fitting_pairs(a, b))[0], "i", "k")
    want_r, want_s, own = set(), set(), {}
    for x in refs:
        own[x["network"]] = Net.of(x, STRONG)
        used = {c["s"] for c in x["cells"]}
        for y in tgts:
            for s, j in Search(own[x["network"]], Net.of(y, STRONG)).pairs():
                want_r |= {(x["network"], y["network"], i, k) for i, k in enumerate(j)}
                want_s |= {(x["network"], y["network"], i, t) for i, t in enumerate(s) if i in used}
    assert want_r <= got_r <= before and want_s <= got_s and len(got_r) < len(before)
    far = {y["network"]: Net.of(y, STRONG) for y in tgts}
    for ref, tgt, i, k in got_r:  # each rule holds for what is left
        assert all(any((ref, tgt, s, t) in got_s and far[tgt].cells[k].get(t) == c for t in far[tgt].cells[k]) for s, c in own[ref].cells[i].items())
        others = {n: [z for r, t, m, z in got_r if (r, t, m) == (ref, tgt, n)] for n in range(len(own[ref].reactions))}
        assert any(c[i] == k for c in itertools.product(*(others[n] for n in sorted(others))) if len(set(c)) == len(c))
    for ref, tgt, s, t in got_s:
        assert all(any((ref, tgt, i, k) in got_r and far[tgt].cells[k].get(t) == c[s] for k in range(len(far[tgt].cells))) for i, c in enumerate(own[ref].cells) if s in c)


def test_assignments_are_counted_exactly(spark):
    rng, rows, want = random.Random(3), [], {}
    for n in range(60):
        lists = [sorted(rng.sample(range(6), rng.randint(1, 5))) for _ in range(rng.randint(1, 5))]
        rows += [("r%d" % n, i, "t", k) for i, x in enumerate(lists) for k in x]
        want["r%d" % n] = sum(len(set(c)) == len(c) for c in itertools.product(*lists)), lists
    found = spark.createDataFrame([*rows, ("lost", 0, "t", 1)], "reference string, ref_node int, target string, tgt_node int")
    nodes = found.select("reference", "ref_node").distinct().union(spark.createDataFrame([("lost", 1)], "reference string, ref_node int"))
    got = {x["reference"]: x for x in counting.log10_assignments(counting.candidate_lists(found, nodes)).collect()}
    assert got.pop("lost")["log10_n"] is None
    for name, (n, lists) in want.items():
        assert got[name]["is_exact"] and (got[name]["log10_n"] is None if n == 0 else abs(got[name]["log10_n"] - math.log10(n)) < 1e-9)
        assert abs(got[name]["log10_product"] - sum(math.log10(len(x)) for x in lists)) < 1e-9
    wide = [sorted(rng.sample(range(14), 7)) for _ in range(7)]
    true = counting.log10_choices(wide)
    rough = counting.log10_choices(wide, states=10, draws=20_000)
    assert true[1] and not rough[1] and abs(true[0] - rough[0]) < 0.05 and counting.log10_choices([]) == (0.0, True)


@pytest.mark.parametrize("most", [0.0, 1.0, 2.5, 9.0])
def test_cut_to_a_budget(spark, most):
    """Cut to the greatest common length that holds the budget, each list keeping one; the same for the same seed."""
    rng, lists = random.Random(4), {}
    for n in range(12):
        lists |= {(f"r{n}", i): sorted(rng.sample(range(30), rng.choice([1, 2, 2, 5, 12]))) for i in range(rng.randint(1, 5))}
    found = spark.createDataFrame([(r, i, "t", k) for (r, i), x in lists.items() for k in x], "reference string, ref_node int, target string, tgt_node int")
    kept = counting.pruned(found, most, seed=1).collect()
    assert sorted(map(str, kept)) == sorted(map(str, counting.pruned(found.repartition(3), most, seed=1).collect()))
    for n in range(12):
        sizes = {k: len(x) for k, x in lists.items() if k[0] == f"r{n}"}
        fits = lambda cap: sum(math.log10(min(v, cap)) for v in sizes.values()) <= most + 1e-6  # noqa: E731, B023
        length = max([c for c in range(1, 31) if fits(c)], default=1)
        own = [x for x in kept if x["reference"] == f"r{n}"]
        after = {k: sum(x["ref_node"] == k[1] for x in own) for k in sizes}
        assert after == {k: min(v, length) for k, v in sizes.items()}
        assert {x["is_changed"] for x in own} == {any(v > length for v in sizes.values())}
        assert all(x["tgt_node"] in lists[x["reference"], x["ref_node"]] for x in own)


def brute_group(net):
    n, m = len(net.species), len(net.reactions)
    return [(p, q) for p in itertools.permutations(range(n)) for q in itertools.permutations(range(m)) if all({p[s]: c for s, c in net.cells[j].items()} == net.cells[q[j]] for j in range(m))]


def test_automorphism_groups(spark):
    rows = random_rows(5, 40, "n", 4, 4)
    got = {x["network"]: x for x in cluster.automorphism_groups(table(spark, rows)).collect()}
    several = 0
    for row in rows:
        group, n = brute_group(Net.of(row, STRONG)), len(row["species"])
        orbit = lambda side, i: frozenset(g[side][i] for g in group)  # noqa: E731, B023
        want = [{frozenset(names[i] for i in orbit(side, k)) for k in range(len(names)) if len(orbit(side, k)) > 1} for side, names in ((0, row["species"]), (1, row["reactions"]))]
        x = got[row["network"]]
        assert x["group_size"] == str(len(group)) and [set(map(frozenset, x[c])) for c in ("species_orbits", "reaction_orbits")] == want
        several += len(group) > 1 and n > 0
    assert several > 5
    ring = {"network": "ring", "species": [f"s{i}" for i in range(8)], "reactions": [f"r{i}" for i in range(8)], "cells": [{"s": (i + d) % 8, "j": i, "r": 1.0 - d, "p": float(d)} for i in range(8) for d in (0, 1)]}
    assert cluster.automorphisms(Net.of(ring, STRONG)) == (8, [list(range(8)), list(range(8, 16))]) and cluster.automorphisms(Net.of(ring, STRONG), 1) == (None, [])


def shuffled(rng, row, name):
    s, j = rng.sample(range(len(row["species"])), len(row["species"])), rng.sample(range(len(row["reactions"])), len(row["reactions"]))
    return dict(row, network=name, cells=[dict(c, s=s[c["s"]], j=j[c["j"]]) for c in row["cells"]])


def test_colours_and_clusters_beyond_the_budget(spark):
    """Rings of two lengths look alike to colours; a budget too small for forms is made up for by comparison."""
    rng = random.Random(6)
    arcs = lambda *rings: [{"s": a, "j": k, "r": 1.0, "p": 0.0} for k, (a, _) in enumerate(rings)] + [{"s": b, "j": k, "r": 0.0, "p": 1.0} for k, (_, b) in enumerate(rings)]
    loop = lambda start, n: [(start + i, start + (i + 1) % n) for i in range(n)]
    whole = lambda name, *ns: {"network": name, "species": [f"s{i}" for i in range(sum(ns))], "reactions": [f"r{i}" for i in range(sum(ns))], "cells": arcs(*(x for k, n in enumerate(ns) for x in loop(sum(ns[:k]), n)))}
    rows = [shuffled(rng, whole(f"{kind}-{i}", *ns), f"{kind}-{i}") for kind, ns in (("six", (6,)), ("threes", (3, 3))) for i in range(3)]
    rows += [shuffled(rng, r, f"{r['network']}-{i}") for r in random_rows(7, 10, "x", 4, 4) for i in range(2)]
    t = table(spark, rows)
    key = {x["network"]: x for x in refinement.refined(t).collect()}
    assert key["six-0"]["key"] == key["threes-0"]["key"] and not key["six-0"]["is_discrete"]
    nets = {r["network"]: Net.of(r, STRONG) for r in rows}
    same = lambda a, b: (not nets[a].reactions and not nets[b].reactions and len(nets[a].species) == len(nets[b].species)) or Search(nets[a], nets[b], subset=False).summary()[0] > 0
    for budget in (cluster.BUDGET, 1):
        group = {x["network"]: x["cluster"] for x in cluster.clusters(t, budget=budget).collect()}
        assert all((group[a] == group[b]) == same(a, b) for a, b in itertools.combinations(nets, 2))
    alone = cluster.clusters(t, budget=1, exact=False).where("is_indeterminate").count()
    assert alone >= 6


def test_resume_after_a_broken_run(spark, catalogue, tmp_path, monkeypatch):
    refs, tgts = (table(spark, x) for x in catalogue)
    path, marked = str(tmp_path / "kept"), []
    real = finder.mark

    def breaks(spark, path, part, text):
        if len(marked) == 2:
            raise RuntimeError("killed")
        marked.append(part)
        real(spark, path, part, text)

    monkeypatch.setattr(finder, "mark", breaks)
    with pytest.raises(RuntimeError, match="killed"):
        finder.resume(refs, tgts, path, parts=4)
    assert sorted(finder.markers(spark, path)) == sorted(marked) and len(list((tmp_path / "kept" / "rows").iterdir())) == 3
    done = []
    monkeypatch.setattr(finder, "mark", lambda *a: (done.append(a[2]), real(*a)))
    want = sorted(map(str, search.mapping_counts(refs, tgts, misses=True).select("reference", "target", "n_pairs").collect()))
    rows = lambda df: sorted(map(str, df.select("reference", "target", "n_pairs").collect()))
    assert rows(finder.resume(refs, tgts, path, parts=4)) == want and set(done) == set(range(4)) - set(marked)
    done.clear()
    assert rows(finder.resume(refs, tgts, path, parts=4)) == want and not done
    less = tgts.where(F.col("network") != "b3")
    assert len(rows(finder.resume(refs, less, path, parts=4))) == len(want) - 12 and len(done) == 1


def test_experiments_are_exported_as_edge_lists(spark, tmp_path):
    from stoichion.model import from_nested
    from stoichion.operators import benchmark, projection

    planted = benchmark.population(spark, 4, 3, 3, 2).cache()
    benchmark.export(planted, str(tmp_path / "out"))
    for networks, side in zip(benchmark.sides(planted), ("reference", "target"), strict=True):
        want = {x["network"]: x["text"] for x in projection.edge_list_text(from_nested(networks)).collect()}
        got = spark.read.text(str(tmp_path / "out" / side), wholetext=True).collect()
        assert {str(x["network"]): x["value"].rstrip("\n") for x in got} == want and len(want) == 4
