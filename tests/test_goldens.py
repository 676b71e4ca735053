"""Hand-made networks with known answers."""

import itertools

import pytest

from stoichion import api
from stoichion.functions.columns import STRONG, WEAK
from stoichion.model import from_nested
from stoichion.operators import cluster, projection, search
from stoichion.operators import random_networks as rn
from stoichion.operators.search import Net, Search
from stoichion.sources import antimony, files

N1 = "J0: S1 -> S1 + S2; J1: S2 -> S3"
N2 = "Ja: S2 -> S2 + S1; Jb: S1 -> S3"
N3 = "Ja: 2 S1 -> 2 S1 + S2; Jb: S2 -> S3"
N4 = "Ja: S1 -> S2; Jb: S1 -> S3"


def search_of(ref: str, tgt: str, identity=STRONG, **options) -> Search:
    return Search(Net.of(antimony.parse(ref), identity), Net.of(antimony.parse(tgt), identity), **options)


def brute(ref: Net, tgt: Net) -> set:
    """All mappings by trying every choice, straight from the definition."""
    out = set()
    for j in itertools.permutations(range(len(tgt.reactions)), len(ref.reactions)):
        if any(ref.klass(a) != tgt.klass(b) for a, b in enumerate(j)):
            continue
        for s in itertools.permutations(range(len(tgt.species)), len(ref.species)):
            same = all(ref.cells[a].get(i, (0, 0)) == tgt.cells[b].get(s[i], (0, 0)) for a, b in enumerate(j) for i in range(len(s)))
            closed = all(not c[0] or t in s for b in j for t, c in tgt.cells[b].items())
            if same and closed:
                out.add((s, j))
    return out


def test_two_reactions_in_three(spark):
    found = api.find_reference_in_target(spark, "R1: S2->S3; R2: S1->S2", "T1: A->B\nT2: B->C\nT3: B+C->").collect()
    names = antimony.parse("R1: S2->S3; R2: S1->S2")["species"]
    assert len(found) == 1 and found[0]["reactions"] == [1, 0]
    assert dict(zip(names, found[0]["species"], strict=True)) == {"S2": 1, "S3": 2, "S1": 0}


@pytest.mark.parametrize("identity", [STRONG, WEAK])
@pytest.mark.parametrize("subset", [True, False])
def test_itself(identity, subset):
    assert list(search_of("J1: A -> B", "J1: A -> B", identity, subset=subset).pairs()) == [([0, 1], [0])]


def test_renaming_and_projection():
    assert search_of(N1, N2, STRONG, subset=False).summary()[0] == 1
    assert search_of(N1, N3, WEAK, subset=False).summary()[0] > 0
    assert search_of(N1, N3, STRONG, subset=False).summary()[0] == 0
    assert search_of(N1, N4, STRONG, subset=False).summary()[0] == 0


def test_doubled():
    twice = N1 + "; K0: T1 -> T1 + T2; K1: T2 -> T3"
    assert search_of(N1, twice, subset=False).summary()[0] == 0
    assert search_of(N1, twice).summary()[0] == 2


def test_regression_of_eight_reactions():
    ref = "JJ0: S3 -> S2; JJ1: S2 -> S2; JJ2: S2 -> S4; JJ3: S7 -> S2 + S7"
    tgt = "JJ2: S2 -> S4; J0: -> S1; JJ3: S7 -> S7 + S2; J3: S1 -> S6; JJ1: S2 -> S2; J2: S3 + S0 -> S1 + S7 + S4; JJ0: S3 -> S2; J1: S6 -> S5"
    assert search_of(ref, tgt).summary()[0] >= 1


def test_catalogue_counts():
    """A reversible chain with spectators in a target of seven species where it occurs once: 2 * P(4, 3) mappings."""
    ref = antimony.parse("a: M -> Mp; b: Mp -> Mpp; c: Mpp -> Mp; d: Mp -> M")
    ref["species"] += ["X", "Y", "Z"]
    tgt = antimony.parse("a: p -> q; b: q -> p; c: q -> r; d: r -> q; e: u + v -> w; f: w -> x")
    assert Search(Net.of(ref, STRONG), Net.of(tgt, STRONG)).summary()[0] == 48


def test_against_brute_force(spark):
    rows = [r.asDict(recursive=True) for k in ("uniform", "type") for r in rn.generate(spark, 25, 3, 2, 5, k).collect()]
    large = [r.asDict(recursive=True) for r in rn.generate(spark, 25, 4, 4, 9).collect()]
    for identity in (STRONG, WEAK):
        for a, b in itertools.product(rows[:30], large[:10]):
            ref, tgt = Net.of(a, identity), Net.of(b, identity)
            found = {(tuple(s), tuple(j)) for s, j in Search(ref, tgt).pairs()}
            want = brute(ref, tgt) if ref.reactions and tgt.reactions else set()
            assert found == want and Search(ref, tgt).summary()[0] == len(want)


def test_planted_pairs_are_found(spark):
    for x in rn.experiments(spark, 20, 4, 4, 4, seed=3).collect():
        ref, tgt = (Net.of(x[k].asDict(recursive=True), STRONG) for k in ("reference", "target"))
        if ref.reactions and len(ref.species) == len(x["species_at"]):
            assert any(s == list(x["species_at"]) and j == list(x["reactions_at"]) for s, j in itertools.islice(Search(ref, tgt).pairs(), 20_000))
    for x in rn.experiments(spark, 10, 4, 4, 4, identical=False, seed=3).collect():
        ref, tgt = (Net.of(x[k].asDict(recursive=True), STRONG) for k in ("reference", "target"))
        assert Search(ref, tgt).summary()[0] == 0


def test_budget_truncates():
    s = search_of("a: A -> B; b: B -> C; c: C -> D", "; ".join(f"r{i}: A{i} -> A{i + 1}" for i in range(30)), budget=5)
    s.summary()
    assert s.truncated


def test_boundary_species_come_last():
    row = antimony.parse("J0: $S1 -> S2")
    assert row["species"] == ["S2", "S1"] and row["cells"] == [{"s": 0, "j": 0, "r": 0.0, "p": 1.0}, {"s": 1, "j": 0, "r": 1.0, "p": 0.0}]


def test_antimony_forms():
    text = "// c\nmodel *m(a)\n species A, $X;\n A + 2 B => C; k1*A\n k1 = 3\n function f(x)\n x -> 2\nend\n R: C -> ; 1\nend"
    row = antimony.parse(text)
    assert row["network"] == "m" and row["species"] == ["A", "B", "C", "X"] and row["reactions"] == ["_J0", "R"]
    with pytest.raises(antimony.AntimonyError):
        antimony.parse("A + + 2 -> 3 4")


def test_boundary_networks_and_text(spark):
    rows = [antimony.parse("R1: A -> ; R2: -> B", "x"), antimony.parse("R1: A -> ; R2: -> B; R3: A -> C", "y"), antimony.parse(N3, "z")]
    crn = from_nested(spark.createDataFrame(rows, files.NESTED))
    assert dict(map(tuple, projection.boundary_networks(crn).collect())) == {"x": True, "y": False, "z": False}
    assert "Ja: 2.0 S1 -> 2.0 S1 + S2" in [r["text"] for r in projection.pretty_reactions(crn).collect()]


def test_clusters_are_classes(spark):
    import numpy as np

    rng, rows = np.random.default_rng(1), []
    for i in range(6):
        base = rn.by_type(rng, f"n{i}", 5, 5)
        for k in range(3):
            row, _, _ = rn.permuted(rng, base)
            rows.append(row | {"network": f"n{i}-{k}"})
    found = cluster.clusters(spark.createDataFrame(rows, files.NESTED)).collect()
    nets = {r["network"]: Net.of(r, STRONG) for r in rows}
    group = {x["network"]: x["cluster"] for x in found}
    for a, b in itertools.combinations(nets, 2):
        same = Search(nets[a], nets[b], subset=False).summary()[0] > 0
        assert (group[a] == group[b]) == same


def test_json_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([antimony.parse(N1, "a"), antimony.parse(N3, "b")], files.NESTED)
    files.write_json_lines(rows, str(tmp_path / "x"))
    back = files.read_json_lines(spark, str(tmp_path / "x"))
    key = lambda r: (r["network"], r["species"], r["reactions"], sorted(map(tuple, r["cells"])))
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect()))


def test_directory_bad_file_and_resume(spark, tmp_path):
    d = tmp_path / "models"
    d.mkdir()
    (d / "good.ant").write_text(N1)
    (d / "plain").write_text(N2)
    (d / "bad.ant").write_text("A + -> 3 ->")
    (d / "x.xml").write_text("<sbml><model id='m'><listOfSpecies><species id='A'/><species id='B' boundaryCondition='true'/></listOfSpecies><listOfReactions><reaction id='r'><listOfReactants><speciesReference species='A' stoichiometry='10'/></listOfReactants><listOfProducts><speciesReference species='B'/></listOfProducts></reaction></listOfReactions></model></sbml>")
    found = files.read_directory(spark, str(d))
    assert {r["network"] for r in files.networks(found).collect()} == {"good", "plain", "x"}
    assert found.where("error IS NOT NULL").count() == 1
    out = str(tmp_path / "out.txt")
    api.make_serialization_file(spark, str(d), out)
    api.make_serialization_file(spark, str(d), out)
    assert files.read_json_lines(spark, out).count() == 3
    assert api.cluster_models(spark, out).count() == 2


def test_finder_table_and_resume(spark, tmp_path):
    from stoichion.plans import finder

    refs = spark.createDataFrame([antimony.parse("a: A -> B", "r1"), antimony.parse("a: A + B -> C", "r2")], files.NESTED)
    tgts = spark.createDataFrame([antimony.parse(N1, "t1"), antimony.parse(N4, "t2")], files.NESTED)
    table = {(r["reference_name"], r["target_name"]): r for r in finder.find(refs, tgts).collect()}
    assert len(table) == 4 and table["r1", "t2"]["num_mapping_pair"] == 2 and table["r2", "t1"]["num_mapping_pair"] == 0
    assert "reaction_names" in table["r1", "t2"]["name_dct"] and table["r2", "t1"]["name_dct"] is None
    path = str(tmp_path / "done")
    finder.resume(refs, tgts.where("network = 't1'"), path)
    assert finder.resume(refs, tgts, path).count() == 4
    assert finder.resume(refs, tgts, path).count() == 4
    assert finder.two_phase(refs, tgts, first=0).count() == 4


def test_many_blocks_give_the_same(spark):
    refs, tgts = rn.generate(spark, 12, 3, 2, 1), rn.generate(spark, 12, 6, 8, 2)
    one, many = (sorted(map(str, search.mapping_counts(refs, tgts, block_cells=n).collect())) for n in (10**6, 5))
    assert one == many


def test_stream(spark, tmp_path):
    from stoichion.streaming.incremental import match_stream

    src = tmp_path / "in"
    src.mkdir()
    refs = spark.createDataFrame([antimony.parse("a: A -> B", "r")], files.NESTED)
    files.write_json_lines(spark.createDataFrame([antimony.parse(N4, "t")], files.NESTED), str(src), "overwrite")
    match_stream(spark, str(src), refs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_significance(spark):
    from stoichion.operators import significance

    refs = spark.createDataFrame([antimony.parse("a: A -> B", "r")], files.NESTED)
    row = significance.subset_chance(refs, 40, 4, 4).first()
    assert row["n"] == 40 and 0 <= row["p_found"] <= 1 and row["p_truncated"] == 0
    assert significance.equal_chance(refs, 40, 2, 1).first()["p_equal"] > 0
    assert significance.occurrence(spark, [(2, 1)], 3, 20).count() == 1
    assert significance.collisions(spark, [(2, 2)], 30).first()["num_network"] == 30
