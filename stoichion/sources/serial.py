"""JSON forms of matrices, constraints, collections, clusters and experiments, nested as text within text.

A collection, cluster or benchmark is one JSON text by its format, so its members come together in one row; those of any size are
dealt to several texts of that format, or go into JSON lines (sources/files.py). Reading raises an error on text of another class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoichion.sources.files import JSON, MATRIX_JSON, PAIR_JSON, from_json, matrices, to_json
from stoichion.store import saved, workspace

# Names of the fields.
FLAT = "s_reactant_lst array<double>, s_product_lst array<double>, s_network_name string, s_reaction_names array<string>, s_species_names array<string>"
COLLECTION_JSON = "s_id string, s_networks array<string>, s_directory string"
CONSTRAINT_JSON = "s_id string, s_reactant_NMAT string, s_product_nmat string"
MEMBER_JSON = "s_id string, s_network_name string, s_processing_time double, s_is_indeterminate boolean, s_assignment_collection array<string>"
CLUSTER_JSON = "s_id string, s_processed_networks array<string>, s_identity string, s_hash_val bigint, s_antimony_directory string"
EXPERIMENT_JSON = "s_id string, s_reference string, s_target string, s_assignment_pair string"
RUNNER_JSON = "s_id string, s_reference_size int, s_expansion_factor int, s_num_experiment int, s_is_identical boolean, s_experiments array<string>, s_identity string"
RESULT_JSON = "s_id string, s_benchmark_runner string, s_num_experiment int, s_runtimes array<double>, s_num_success int, s_num_truncated int, s_is_identicals array<boolean>, s_is_truncateds array<boolean>"
#: Values of matrices in one text of a collection, experiments in one of a runner.
TEXT_VALUES, TEXT_EXPERIMENTS = 100_000, 200
KEEP_NULLS = {"ignoreNullFields": "false"}


def read(text: Column, schema: str, name: str) -> Column:
    """The struct in a JSON text; an error where its class isn't the one named."""
    x = F.from_json(text, schema)
    other = F.raise_error(F.concat(F.lit(f"expected {name} but got "), F.coalesce(x["s_id"], F.lit("none"))))
    return F.when(F.contains(F.coalesce(x["s_id"], F.lit("")), F.lit(name)), x).otherwise(other)


def _tagged(name: str, *fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(name).alias("s_id"), *fields), KEEP_NULLS)


def flat_rows(networks: DataFrame) -> DataFrame:
    """A row for each network with its two matrices flattened row by row, and its names."""
    return networks.select(
        F.flatten(matrices("r")).alias("s_reactant_lst"), F.flatten(matrices("p")).alias("s_product_lst"),
        F.col("network").alias("s_network_name"), F.col("reactions").alias("s_reaction_names"), F.col("species").alias("s_species_names"),
    )


def flat_to_json(rows: DataFrame) -> DataFrame:
    """(value): a JSON text for each row of flat_rows(), whose lists may also be text like [1.0, 2.0]."""
    kinds = {"s_reactant_lst": "array<double>", "s_product_lst": "array<double>", "s_reaction_names": "array<string>", "s_species_names": "array<string>"}
    lists = {c: F.from_json(F.translate(F.col(c), "'", '"'), k) if dict(rows.dtypes)[c] == "string" else F.col(c) for c, k in kinds.items()}
    rows = rows.withColumns(lists)
    n = F.size("s_reaction_names")
    shaped = lambda c: F.transform("s_species_names", lambda _, i: F.slice(c, i * n + 1, n)).alias(c)
    return rows.select(_tagged("Network", F.col("s_network_name"), shaped("s_reactant_lst"), shaped("s_product_lst"), F.col("s_reaction_names"), F.col("s_species_names")).alias("value"))


def collection_to_json(networks: DataFrame, by: str | None = None, most: int | None = None) -> DataFrame:
    """(directory, value): one JSON text for the networks of each value of the column by, or for all of them; with most, as many texts
    as it takes for each to have about so many values in its matrices, networks being dealt by a hash of their names.
    """
    at = networks.select(F.lit(None).cast("string").alias("directory") if by is None else F.col(by).cast("string").alias("directory"), "network", "species", "reactions", "cells")
    of = ["directory"]
    if most is not None:
        n = at.groupBy(F.col("directory").alias("_directory")).agg(F.ceil(F.sum(F.size("species").cast("long") * F.size("reactions")) / most).alias("_n"))
        dealt = F.pmod(F.xxhash64("network"), F.greatest("_n", F.lit(1)))
        at = at.join(n, F.col("directory").eqNullSafe(F.col("_directory"))).withColumn("_text", dealt).drop("_directory", "_n")
        of = ["directory", "_text"]
    lines = at.withColumn("line", to_json_column())
    own = lines.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("network", "line")))["line"].alias("lines"))
    return own.select("directory", _tagged("NetworkCollection", F.col("lines").alias("s_networks"), F.col("directory").alias("s_directory")).alias("value"))


def to_json_column() -> Column:
    """The JSON text of a network in a row."""
    return F.to_json(F.struct(F.lit("Network").alias("s_id"), F.col("network").alias("s_network_name"), matrices("r").alias("s_reactant_lst"), matrices("p").alias("s_product_lst"), F.col("reactions").alias("s_reaction_names"), F.col("species").alias("s_species_names")))


def collection_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """(directory, network, species, reactions, cells) of collections as JSON texts."""
    x = rows.select(read(F.col(value), COLLECTION_JSON, "NetworkCollection").alias("x"))
    # Fields first: exploded beside x, each line would carry the whole text.
    own = x.select(F.col("x.s_directory").alias("directory"), F.col("x.s_networks").alias("lines"))
    return from_json(own.select("directory", F.explode("lines").alias("line")), "line", keep=["directory"])


def matrix_to_json(cells: DataFrame, keys: list[str], row_description: str = "", column_description: str = "", name: str = "value") -> DataFrame:
    """(keys, value): one JSON text for each matrix (keys, row, col, value), names in order, 0 where there is no cell."""
    cols = cells.groupBy(*keys).agg(F.sort_array(F.collect_set("col")).alias("cols"))
    lines = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("value").cast("double")))).alias("held"))
    own = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", F.map_entries("held").alias("held")))).alias("lines"))
    at = own.join(cols, keys) if keys else own.crossJoin(cols)
    value = lambda x, c: F.coalesce(F.try_element_at(F.map_from_entries(x["held"]), c), F.lit(0.0))
    values = F.transform("lines", lambda x: F.transform("cols", lambda c: value(x, c)))
    text = _tagged("NamedMatrix", F.col("lines.row").alias("s_row_names"), F.col("cols").alias("s_column_names"), F.lit(row_description).alias("s_row_description"), F.lit(column_description).alias("s_column_description"), values.alias("s_values"))
    return at.select(*keys, text.alias(name))


def matrix_from_json(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, row, col, value): cells of matrices as JSON texts, zeros too."""
    x = rows.select(*keys, read(F.col(value), MATRIX_JSON, "NamedMatrix").alias("x"))
    lines = x.select(*keys, F.col("x.s_column_names").alias("cols"), F.inline(F.arrays_zip(F.col("x.s_row_names").alias("row"), F.col("x.s_values").alias("held"))))
    return lines.select(*keys, "row", F.inline(F.arrays_zip(F.col("cols").alias("col"), F.col("held").alias("value"))))


def constraint_to_json(reactant: DataFrame, product: DataFrame, keys: list[str], name: str = "ReactionConstraint") -> DataFrame:
    """(keys, value): a JSON text that holds those of the two matrices."""
    both = matrix_to_json(reactant, keys, name="r").join(matrix_to_json(product, keys, name="p"), keys)
    return both.select(*keys, _tagged(name, F.col("r").alias("s_reactant_NMAT"), F.col("p").alias("s_product_nmat")).alias("value"))


def constraint_from_json(rows: DataFrame, keys: list[str], name: str = "ReactionConstraint", value: str = "value") -> DataFrame:
    """(keys, side, row, col, value): cells of both matrices, side being r or p."""
    x = rows.select(*keys, read(F.col(value), CONSTRAINT_JSON, name).alias("x"))
    parts = x.select(*keys, F.inline(F.array(F.struct(F.lit("r").alias("side"), F.col("x.s_reactant_NMAT").alias("text")), F.struct(F.lit("p").alias("side"), F.col("x.s_product_nmat").alias("text")))))
    return matrix_from_json(parts, [*keys, "side"], "text")


def member_to_json() -> Column:
    """The JSON text of a cluster's member: columns network, seconds, is_indeterminate and pairs (JSON texts of mappings)."""
    return _tagged("ProcessedNetwork", F.col("network").cast("string").alias("s_network_name"), F.col("seconds").alias("s_processing_time"), F.col("is_indeterminate").alias("s_is_indeterminate"), F.col("pairs").alias("s_assignment_collection"))


def member_from_json(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, network, seconds, is_indeterminate, pairs); mappings stay JSON texts."""
    x = rows.select(*keys, read(F.col(value), MEMBER_JSON, "ProcessedNetwork").alias("x"))
    return x.select(*keys, F.col("x.s_network_name").alias("network"), F.col("x.s_processing_time").alias("seconds"), F.col("x.s_is_indeterminate").alias("is_indeterminate"), F.col("x.s_assignment_collection").alias("pairs"))


def cluster_to_json(members: DataFrame, identity: str, directory: str | None = None) -> DataFrame:
    """(cluster, value): one JSON text for each cluster of rows (cluster, key, network, seconds, is_indeterminate, pairs); key is
    what the members share, and its 64-bit hash is written.
    """
    own = members.withColumn("line", member_to_json()).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("network", "line")))["line"].alias("lines"), F.min(F.xxhash64("key")).alias("hash"))
    text = _tagged("ProcessedNetworkCollection", F.col("lines").alias("s_processed_networks"), F.lit(f"id_{identity}").alias("s_identity"), F.col("hash").alias("s_hash_val"), F.lit(directory).cast("string").alias("s_antimony_directory"))
    return own.select("cluster", text.alias("value"))


def cluster_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """(hash, identity, directory, network, seconds, is_indeterminate, pairs)."""
    x = rows.select(read(F.col(value), CLUSTER_JSON, "ProcessedNetworkCollection").alias("x"))
    lines = x.select(F.col("x.s_hash_val").alias("hash"), F.col("x.s_identity").alias("identity"), F.col("x.s_antimony_directory").alias("directory"), F.explode("x.s_processed_networks").alias("value"))
    return member_from_json(lines, ["hash", "identity", "directory"])


def cluster_lines(found: DataFrame, identity: str) -> DataFrame:
    """(processed_network_repr, structural_identity, num_hash, max_hash): a text for each cluster (cluster, n, n_indeterminate,
    networks) beside the number of clusters and the size of the largest.
    """
    total = found.agg(F.count("*").alias("num_hash"), F.max("n").alias("max_hash"))
    mark = F.when(F.col("n_indeterminate") > 0, "*").otherwise("")
    text = F.concat(F.lit("+" if identity == "strong" else "-"), F.col("n").cast("string"), mark, F.lit(": "), F.array_join("networks", ", "))
    return found.crossJoin(F.broadcast(total)).select(text.alias("processed_network_repr"), F.lit(identity).alias("structural_identity"), "num_hash", "max_hash")


def experiment_to_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value) of rows (keys, reference, target, pair), all JSON texts."""
    return rows.select(*keys, _tagged("Experiment", F.col("reference").alias("s_reference"), F.col("target").alias("s_target"), F.col("pair").alias("s_assignment_pair")).alias("value"))


def experiment_from_json(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    x = rows.select(*keys, read(F.col(value), EXPERIMENT_JSON, "Experiment").alias("x"))
    return x.select(*keys, F.col("x.s_reference").alias("reference"), F.col("x.s_target").alias("target"), F.col("x.s_assignment_pair").alias("pair"))


def runner_to_json(experiments: DataFrame, reference_size: int, expansion_factor: int, is_identical: bool, identity: str, most: int | None = None) -> DataFrame:
    """(value): one JSON text for experiments (number, value); with most, texts (first, value) of so many experiments at most, first
    being the place of a text's first one among all, in the order of numbers.
    """
    line = F.sort_array(F.collect_list(F.struct("number", "value")))["value"].alias("lines")
    if most is None:
        lines = experiments.agg(line)
    else:
        at = _placed(experiments)
        text = F.floor(F.col("_place") / most)
        lines = at.groupBy("_before", text.alias("_text")).agg(line).withColumn("first", F.col("_before") + F.col("_text") * most)
    return lines.select(*([] if most is None else ["first"]), _tagged("BenchmarkRunner", F.lit(reference_size).alias("s_reference_size"), F.lit(expansion_factor).alias("s_expansion_factor"), F.size("lines").alias("s_num_experiment"), F.lit(is_identical).alias("s_is_identical"), F.col("lines").alias("s_experiments"), F.lit(f"id_{identity}").alias("s_identity")).alias("value"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with _before and _place: in the order of numbers, they are dealt to ranges, _before rows stand before a row's range, and
    _place is its place there.
    """
    folder = workspace(rows.sparkSession, "placed")
    at = F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    dealt = saved(rows.repartitionByRange("number").sortWithinPartitions("number").withColumn("_at", at), folder, "rows")
    n = dealt.groupBy(F.col("_at.part").alias("_part")).agg(F.count("*").alias("n"))
    before = n.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(before), F.col("_at.part") == F.col("_part")).select(*rows.columns, "_before", F.col("_at.place").alias("_place"))


def runner_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """(number, value, reference_size, expansion_factor, is_identical, identity): a row for each experiment; number counts from first,
    where rows have it.
    """
    first = F.col("first") if "first" in rows.columns else F.lit(0)
    x = rows.select(first.alias("first"), read(F.col(value), RUNNER_JSON, "BenchmarkRunner").alias("x"))
    each = x.select("first", F.col("x.s_reference_size").alias("reference_size"), F.col("x.s_expansion_factor").alias("expansion_factor"), F.col("x.s_is_identical").alias("is_identical"), F.col("x.s_identity").alias("identity"), F.posexplode("x.s_experiments").alias("number", "value"))
    return each.withColumn("number", F.col("first") + F.col("number")).drop("first")


def result_to_json(runner: DataFrame, results: DataFrame) -> DataFrame:
    """(value) of a runner's JSON text (value) and the results of its experiments (number, seconds, is_identical, is_truncated)."""
    own = results.agg(F.sort_array(F.collect_list(F.struct("number", "seconds", "is_identical", "is_truncated"))).alias("x"))
    n = lambda flag: F.size(F.filter("x", lambda e: e[flag]))
    fields = (F.size("x").alias("s_num_experiment"), F.col("x.seconds").alias("s_runtimes"), n("is_identical").alias("s_num_success"), n("is_truncated").alias("s_num_truncated"), F.col("x.is_identical").alias("s_is_identicals"), F.col("x.is_truncated").alias("s_is_truncateds"))
    return runner.crossJoin(own).select(_tagged("ExperimentResult", F.col("value").alias("s_benchmark_runner"), *fields).alias("value"))


def result_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """(number, seconds, is_identical, is_truncated)."""
    x = rows.select(read(F.col(value), RESULT_JSON, "ExperimentResult").alias("x"))
    zipped = F.arrays_zip(F.col("x.s_runtimes").alias("seconds"), F.col("x.s_is_identicals").alias("is_identical"), F.col("x.s_is_truncateds").alias("is_truncated"))
    return x.select(F.posexplode(zipped).alias("number", "e")).select("number", "e.seconds", "e.is_identical", "e.is_truncated")
