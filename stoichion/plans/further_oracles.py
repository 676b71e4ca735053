"""DuckDB SQL for the queries of further.py."""

from __future__ import annotations

from stoichion.plans.oracles import _STEPS, ORACLES, _add

for _name in ("json_round_trip", "flat_round_trip", "antimony_round_trip", "sbml_round_trip"):
    _add(_name, "SELECT * FROM c")
_add("collection_round_trip", "SELECT CAST(n_reactions AS VARCHAR) AS directory, network, n_species, n AS n_cells FROM sz JOIN (SELECT network, count(*) AS n FROM c GROUP BY 1) USING (network)")
_add("matrix_json_round_trip", "SELECT sp.network, species AS row, CAST(reaction AS VARCHAR) AS col, coalesce(p - r, 0) AS value FROM sp JOIN rx ON sp.network = rx.network LEFT JOIN (SELECT network AS n, species AS s, reaction AS j, r, p FROM c) ON n = sp.network AND s = species AND j = reaction")
_add("constraint_json_round_trip", " UNION ALL ".join(f"SELECT network, '{x}' AS side, species AS row, CAST(reaction AS VARCHAR) AS col, {x} AS value FROM c WHERE {x} > 0" for x in "rp"))
_add("cluster_json_round_trip", "SELECT 'id_strong' AS identity, n_species % 2 = 0 AS is_indeterminate, count(*) AS n, count(DISTINCT n_reactions) AS n_clusters, CAST(sum(network) AS BIGINT) AS total FROM sz GROUP BY 2")
_add(
    "cluster_lines",
    "SELECT '+' || n || CASE WHEN k > 0 THEN '*' ELSE '' END || ': ' || names AS processed_network_repr, 'strong' AS structural_identity, (SELECT count(*) FROM g) AS num_hash, (SELECT max(n) FROM g) AS max_hash FROM g",
    "g AS (SELECT n_reactions, count(*) AS n, count(*) FILTER (n_species % 2 = 0) AS k, string_agg(CAST(network AS VARCHAR), ', ' ORDER BY network) AS names FROM sz GROUP BY 1)",
)
_FIRST = "CASE WHEN {n} > 1 THEN ({n} - 1) || ',' || ({n} - 2) ELSE '0' END"
_add("pair_json_round_trip", f"SELECT network AS reference, {_FIRST.format(n='n_species')} AS species, {_FIRST.format(n='n_reactions')} AS reactions FROM sz")
_add("experiment_json_round_trip", "SELECT row_number() OVER (ORDER BY network) - 1 AS number, CAST(3 AS BIGINT) AS reference_size, 'id_strong' AS identity, network, n_reactions FROM sz")
_add("result_json_round_trip", "SELECT row_number() OVER (ORDER BY network) - 1 AS number, CAST(n_species AS DOUBLE) AS seconds, n_reactions > 5 AS is_identical, n_species > 9 AS is_truncated FROM sz")
_PLACES = """
ro AS (SELECT network, species, row_number() OVER (PARTITION BY network ORDER BY species) - 1 AS i FROM sp),
co AS (SELECT network, reaction, row_number() OVER (PARTITION BY network ORDER BY CAST(reaction AS VARCHAR)) - 1 AS j FROM rx)"""
_add("sub_matrix_places", "SELECT network, species AS row, CAST(reaction AS VARCHAR) AS col, r AS value, 1 - i AS row_no, j AS col_no FROM c JOIN ro USING (network, species) JOIN co USING (network, reaction) WHERE i <= 1 AND j = 0", _PLACES)
_add("matrix_places", "SELECT network, species AS row, i AS row_no FROM ro", _PLACES)
_add("matrix_relabelled", "SELECT network, species AS row, CAST(reaction AS VARCHAR) AS col, p - r AS value FROM c")
_add("matrix_hstack", " UNION ALL ".join(f"SELECT network, species AS row, '{i}:' || reaction AS col, {x} AS value FROM c" for i, x in enumerate("rp")))
_add(
    "matrix_sign_codes",
    "SELECT network, string_agg(CAST(code AS VARCHAR), ',' ORDER BY code) AS code FROM (SELECT network, species, CAST(sum(CASE p - r WHEN 0 THEN 0 WHEN 1 THEN 1000 WHEN -1 THEN 1000000 ELSE 1000000000 END) + any_value(n_reactions) - count(*) FILTER (p <> r) AS BIGINT) AS code FROM c JOIN sz USING (network) GROUP BY 1, 2) GROUP BY 1",
)
_add("equivalent_networks", "SELECT network, count(*) FILTER (r * p > 0) = 0 AS is_equivalent FROM c GROUP BY 1")
_add("nonempty_networks", "SELECT network, network IN (SELECT network FROM w) AS is_nonempty FROM sz")
_add("linear_indices", "SELECT network, species AS row, CAST(reaction AS VARCHAR) AS col, i * n_reactions + j AS index, i AS row_no, j AS col_no FROM c JOIN ro USING (network, species) JOIN co USING (network, reaction) JOIN sz USING (network)", _PLACES)
_add("packed_pairs", "SELECT network, n_species * 1000000 + n_reactions AS code, n_species AS a, n_reactions AS b FROM sz")
_add("row_order", "SELECT network, n_species || '' || n_reactions AS digits, (n_species < 10 OR (n_species = 10 AND n_reactions <= 5)) AS not_after FROM sz")
_add("dealt_rows", "SELECT network, (row_number() OVER (PARTITION BY n_reactions ORDER BY network) - 1) % 4 AS part FROM sz")
_add("repeated_rows", "SELECT network, copy FROM sz, (SELECT CAST(i AS BIGINT) AS copy FROM range(3) t(i))")
_add("pruned_groups", "SELECT n_reactions, count(*) > 20 AS is_truncated, least(count(*), 20) AS n, least(count(*), 20) AS n_networks FROM sz GROUP BY 1")
_LOG = "list_sum(list_transform(generate_series({a}, {b}), lambda x: log10(x)))"
_add(
    "permutation_counts",
    f"SELECT DISTINCT n_species, n_reactions, round({_LOG.format(a=1, b='n_species')} + {_LOG.format(a=1, b='n_reactions')}, 6) AS log10_all, CASE WHEN n_species >= 3 THEN round({_LOG.format(a='n_species - 2', b='n_species')}, 6) END AS log10_three FROM sz",
)
_add("column_functions", "SELECT network, species, replace(species, ',', '') AS name, true AS is_number, false AS is_name_number, network AS number FROM sp")
_add("close_sides", "SELECT network, reaction, species, abs(r * (1 + 1e-6) - p) <= 1e-8 + 1e-5 * p AS is_close FROM c")
_add(
    "species_degree_steps",
    "SELECT network, species AS node, " + ", ".join(f"(SELECT count(*) FROM ss{k} x WHERE x.network = sp.network AND x.{a} = sp.species) AS {n}_{k}" for n, a in (("s", "a"), ("p", "b")) for k in (1, 2)) + " FROM sp",
    _STEPS,
)
_add(
    "feature_options",
    "SELECT * FROM (VALUES ('species', 'none', 'none'), ('species', 'a', 'n_step'), ('species', 'b', 'reactant_product'), ('species', 'a+b', 'n_step+reactant_product'), "
    "('reaction', 'none', 'none'), ('reaction', 'y', 'n_step'), ('reaction', 'z', 'classification'), ('reaction', 'y+z', 'n_step+classification')) t(node, short, long)",
)
_ORDER = """
od AS (SELECT reaction, string_agg(r || ',' || p, ';' ORDER BY species) AS k, count(*) AS n FROM c GROUP BY 1),
odw AS (SELECT reaction, coalesce(string_agg(CASE WHEN r <> p THEN i || ',' || greatest(r - p, 0) || ',' || greatest(p - r, 0) END, ';' ORDER BY i), '') AS k, count(*) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY reaction ORDER BY species) AS i FROM c) GROUP BY 1),
key AS (SELECT reaction AS network, list_sort(list(p - r)) AS k FROM c GROUP BY 1),
bag AS (SELECT reaction AS network, list_sort(list(r || ',' || p)) AS k FROM c GROUP BY 1)"""
_add("order_clusters_by_size", "SELECT min(reaction) AS cluster, count(*) AS n FROM od GROUP BY k HAVING count(*) >= 2", _ORDER)
_add("order_largest_cluster", "SELECT min(reaction) AS cluster, count(*) AS n FROM odw GROUP BY odw.n, k QUALIFY count(*) = max(count(*)) OVER ()", _ORDER)
_add("order_hash_collisions", "SELECT CAST(sum(n) AS BIGINT) AS num_network, count(*) FILTER (n > 1) AS num_shared, count(*) AS num_unique_hash, max(n) AS max_network_in_hash FROM (SELECT count(*) AS n FROM key GROUP BY k)", _ORDER)
_add("order_bucket_members", "SELECT dense_rank() OVER (ORDER BY cluster) - 1 AS collection_idx, cluster, network FROM (SELECT network, min(network) OVER (PARTITION BY k) AS cluster, count(*) OVER (PARTITION BY k) AS n FROM key) WHERE n > 1", _ORDER)
_add("order_identity_clusters", "SELECT min(CAST(network AS VARCHAR)) OVER (PARTITION BY k) AS cluster, CAST(network AS VARCHAR) AS network, false AS is_indeterminate FROM bag", _ORDER)
_add("size_subset_violations", "SELECT l.cluster, sz.network FROM sz JOIN (SELECT n_species, min(network) AS cluster FROM sz GROUP BY 1) l USING (n_species) JOIN sz f ON f.network = l.cluster WHERE sz.n_reactions <> f.n_reactions")
_add("duplicate_shares", "SELECT n_reactions, count(*) AS n, round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END), 6) AS p_duplicate, round(avg(CASE WHEN network % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS p_indeterminate FROM (SELECT *, count(*) OVER (PARTITION BY n_reactions, n_species) AS k FROM sz) GROUP BY 1")
_add("metric_by_conditions", "SELECT n_reactions > 10 AS is_large, n_reactions, round(avg(log10(n_species)), 6) AS mean, round(stddev_pop(log10(n_species)), 6) AS std_pop, count(*) AS n FROM sz GROUP BY 2")
_add("size_curve", "SELECT network, round(cume_dist() OVER (PARTITION BY n_reactions ORDER BY n_species), 6) AS share FROM sz")
_add("merged_checkpoints", "SELECT network, CASE WHEN network % 2 = 0 THEN n_species END AS n_species, n_reactions FROM sz")
_add("checked_assignments", "SELECT reaction AS network, 'same' AS kind FROM od UNION ALL SELECT reaction, 'turned' FROM od WHERE string_split(k, ';') = list_reverse(string_split(k, ';'))", _ORDER)
_add("benchmark_planted", "SELECT CAST(i AS BIGINT) AS id, true AS is_identical, false AS is_truncated FROM range(40) t(i)")
_add("benchmark_options", "SELECT node, short AS option, CAST(12 AS BIGINT) AS n, CAST(12 AS BIGINT) AS n_fitting FROM (VALUES " + ", ".join(f"('{n}', '{o}')" for n, own in (("reaction", "y z y+z none"),) for o in own.split()) + ") t(node, short)")
ORACLES["subnet_data"] = (
    "SELECT f.reference, f.target, n_pairs, a.n_species AS reference_species, a.n_reactions AS reference_reactions, b.n_species AS target_species, b.n_reactions AS target_reactions "
    f"FROM (SELECT CAST(reference AS BIGINT) AS reference, CAST(target AS BIGINT) AS target, n_pairs FROM ({ORACLES['mapping_pairs_strong']})) f JOIN ({ORACLES['network_sizes']}) a ON a.network = f.reference JOIN ({ORACLES['network_sizes']}) b ON b.network = f.target "
    "WHERE f.reference % 5 <> 0 AND f.target % 2 <> 0"
)

__all__ = ["ORACLES"]
