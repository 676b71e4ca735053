"""Relations of the networks: matrices, features, candidates, reports, columns, and the registered queries' SQL."""

import glob
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from stoichion.functions import columns as C
from stoichion.model import crn_view, from_cells, from_nested
from stoichion.operators import compat, features, matrix, report
from stoichion.operators.features import REACTION, SPECIES
from stoichion.plans import finder, queries
from stoichion.plans.oracles import ORACLES
from stoichion.plans.queries import QUERIES
from stoichion.sources import antimony, files

DATA = "/root/testdata/sf0.001"


def networks(spark, **texts):
    return from_nested(spark.createDataFrame([antimony.parse(t, n) for n, t in texts.items()], files.NESTED))


def cells(spark, rows):
    return spark.createDataFrame(rows, "row string, col string, value long")


def test_two_step_truth_table(spark):
    crn = networks(spark, n="J0: -> S2; J1: S2 -> S0; J2: S0 + S1 -> S1; J3: S0 -> S0")
    rows = features.n_step_classes(crn, SPECIES, 1).where("node = 'S0'").collect()
    assert {r["feature"]: r["value"] for r in rows} == {"s1_5": 1, "s1_9": 2, "p1_5": 2, "p1_9": 1}


def test_candidates_keep_same_named_reactions(spark):
    ref = "J0: S1->S1; J1: S0+S1->S0+S1; J2: S0->S0"
    refs, tgts = networks(spark, r=ref), networks(spark, t=ref + "; J3: ->S4; J4: S3->S3; J5: S2->S2+S4")
    found = {(r["ref_node"], r["tgt_node"]) for r in compat.candidates(refs, tgts, REACTION).collect()}
    assert {("J0", "J0"), ("J1", "J1"), ("J2", "J2")} <= found
    every = {(r["ref_node"], r["tgt_node"]) for r in compat.candidates(refs, tgts, REACTION, features.chosen(REACTION, "z")).collect()}
    assert found <= every
    why = compat.explain(refs, tgts, spark.createDataFrame([("r", "t")], "reference string, target string"), REACTION).collect()
    assert {(r["ref_node"], r["tgt_node"]) for r in why} | found == {(a, b) for a in ("J0", "J1", "J2") for b in ("J0", "J1", "J2", "J3", "J4", "J5")}


def test_option_sets():
    assert [features.short_name(x) for x in features.option_sets(SPECIES)] == ["none", "a", "b", "a+b"]
    assert features.long_name(features.chosen(REACTION, "y+z")) == "n_step+classification"
    with pytest.raises(ValueError, match="unknown"):
        features.chosen(SPECIES, "q")


def test_matrices(spark):
    a, b = cells(spark, [("x", "c", 1), ("y", "c", 2)]), cells(spark, [("y", "d", 3), ("z", "d", 0)])
    merged = {(r["row"], r["col"]): r["value"] for r in matrix.vmerge(a, b, []).collect()}
    assert merged == {("x", "c"): 1, ("x", "d"): 0, ("y", "c"): 2, ("y", "d"): 3, ("z", "c"): 0, ("z", "d"): 0}
    assert matrix.without_zero_rows(b, []).count() == 1
    assert matrix.equal(a, a) and not matrix.equal(a, b) and matrix.less_equal(a, a)
    assert matrix.value_at(matrix.transpose(a), "c", "y").first()[0] == 2
    with pytest.raises(ValueError, match="no row"):
        matrix.select_names(a, rows=["q"])
    assert matrix.select_names(a, rows=["y"]).first()["row_no"] == 0
    assert matrix.vstack([a, a]).count() == 4
    with pytest.raises(ValueError, match="differ"):
        matrix.hstack([a, b])
    assert sorted(r["row_no"] for r in matrix.randomize(a, [], 3).collect()) == [0, 1]


def test_key_ignores_order(spark):
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "x string")
    key = lambda m: matrix.canonical_key(m, names("a", "b").withColumnRenamed("x", "row"), names("c", "d").withColumnRenamed("x", "col"), []).first()["key"]
    one = cells(spark, [("a", "c", 1), ("b", "d", -1)])
    assert key(one) == key(cells(spark, [("a", "d", -1), ("b", "c", 1)])) != key(cells(spark, [("a", "c", 1), ("b", "c", -1)]))


def test_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(C.class_label(C.class_index(F.lit(2), F.lit(1)))) == "bi-uni"
    assert get(C.class_code(C.class_index(F.lit(7), F.lit(0)))) == 300
    assert get(C.inverse_permutation(F.array(F.lit(2), F.lit(0), F.lit(1)))) == [1, 2, 0]
    assert get(C.permutations(F.lit(5), F.lit(2))) == 20 and get(C.permutations(F.lit(1), F.lit(2))) == 0
    assert get(C.is_int(F.lit("12"))) and not get(C.is_int(F.lit("1x")))
    assert get(C.strip_name(F.lit("[a,b]"))) == "ab"
    assert get(C.default_names("S", F.lit(2))) == ["S0", "S1"] and get(C.default_names("S", F.lit(0))) == []
    assert round(get(C.array_product(F.array(F.lit(2.0), F.lit(4.0)))), 9) == 8
    assert get(C.model_number(F.lit("ABCDE0000000337"))) == 337
    assert get(C.pack_pair(F.lit(3), F.lit(4))) == 3_000_004
    assert get(C.clamped_log10(F.lit(0.0))) == 5


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 1.0)], "k string, o int, v double")
    assert sorted(r["v"] for r in report.keep_one(df, ["k"], ["o"]).collect()) == [1.0, 5.0]
    assert sorted(r["v"] for r in report.keep_one(df, ["k"], ["o"], last=True).collect()) == [1.0, 7.0]
    assert report.duplicates(df, ["k"]).collect()[0]["n"] == 2
    assert report.summary(df, ["k"], "v").where("k = 'a'").first()["std_pop"] == 1.0
    with pytest.raises(ValueError, match="both have"):
        report.disjoint_union(df, df, "k")
    assert report.same_rows(df, df) and report.is_subset(df.where("k = 'a'"), df, "k")
    assert report.merge([df, df.withColumn("w", F.lit(1))]).where("w IS NULL").count() == 3
    with pytest.raises(FileNotFoundError):
        report.merge([])


def test_empty_networks(spark):
    crn = from_nested(spark.createDataFrame([], files.NESTED))
    assert features.feature_rows(crn, REACTION).count() == 0
    assert compat.candidates(crn, crn, SPECIES).count() == 0
    empty = spark.createDataFrame([], files.NESTED)
    assert finder.find(empty, empty).count() == 0


def _small_crn(spark):
    """Networks 1 to 12 of one to four reactions over three species."""
    rng, rows = random.Random(5), []
    for network in range(1, 13):
        for j in range(1 + network % 4):
            for i in rng.sample(range(3), 2):
                r, p = rng.choice([(1, 0), (0, 1), (1, 1)])
                rows.append((network, 10 * network + j, f"s{i}", r, p))
    return from_cells(spark.createDataFrame(rows, "network long, reaction long, species string, r long, p long")), rows


def _mappings(a, b):
    """Mappings of cells a into cells b, by trying them all; cells: {reaction: {species: (r, p)}}."""
    klass = lambda x: [min(sum(v[i] for v in x.values()), 3) for i in (0, 1)]
    sa, sb, n = sorted({s for x in a.values() for s in x}), sorted({s for x in b.values() for s in x}), 0
    for image in itertools.permutations(b, len(a)):
        if any(klass(a[j]) != klass(b[k]) for j, k in zip(a, image, strict=True)):
            continue
        for chosen in itertools.permutations(sb, len(sa)):
            same = all(a[j].get(s, (0, 0)) == b[k].get(t, (0, 0)) for j, k in zip(a, image, strict=True) for s, t in zip(sa, chosen, strict=True))
            n += same and not any(v[0] for k in image for t, v in b[k].items() if t not in chosen)
    return n


def test_whole_queries_leave_no_network_out(spark):
    crn, rows = _small_crn(spark)
    nets = {}
    for network, reaction, s, r, p in rows:
        nets.setdefault(network, {}).setdefault(reaction, {})[s] = (r, p)
    for most in (1, 2, 3):
        sides = [{x["network"] for x in side.reactions.collect()} for side in queries.halves(crn, most)]
        assert sides[0] | sides[1] == set(nets) and not sides[0] & sides[1]
        want = {(str(a), str(b)): _mappings(nets[a], nets[b]) for a in sides[0] for b in sides[1]}
        got = {(x["reference_name"], x["target_name"]): x["num_mapping_pair"] for x in queries.finder_table(crn, lambda c, most=most: queries.halves(c, most)).collect()}
        assert got == want and sum(want.values())
    whole = [f"{x}_whole" for x in ("reaction_compat", "species_compat", "mapping_pairs_strong", "mapping_pairs_weak", "finder_table", "finder_two_phase", "inferred_networks", "estimated_poc", "explain_incompatible")]
    assert set(whole) <= set(QUERIES) and not set(whole) & set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_whole_queries_of_the_tables(spark):
    n = crn_view(spark, DATA).reactions.groupBy("network").count().collect()
    small = sum(x["count"] <= queries.MOST for x in n)
    pairs = QUERIES["finder_table_whole"](spark, DATA).count()
    explained = QUERIES["explain_incompatible_whole"](spark, "/root/testdata/sf0.001").agg(F.countDistinct("reference", "target")).first()[0]
    assert pairs == small * (len(n) - small) and explained > 1


def test_pending(spark):
    refs, tgts = (spark.createDataFrame([(x,) for x in n], "network string") for n in ("ab", "xy"))
    done = spark.createDataFrame([("a", "x")], "reference string, target string")
    assert finder.pending(refs, tgts, done).count() == 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, DATA)
    order = sorted(found.columns)
    want = db.execute(ORACLES[name]).df()[order].astype(object)
    plain = lambda rows: sorted(str([None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in rows)
    assert plain(found.select(*order).collect()) == plain(want.itertuples(index=False))
