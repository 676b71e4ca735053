"""DuckDB SQL for the registered queries of the network operators."""

from __future__ import annotations

from stoichion.functions.columns import LABELS
from stoichion.plans.queries import MOST

_LABEL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
#: Networks of the order tables, reactions with classes, sizes, references and targets.
BASE = f"""
c AS (
  SELECT o_custkey AS network, l_orderkey AS reaction, p_type AS species,
         count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2, 3),
w AS (SELECT network, reaction, species, greatest(r - p, 0) AS r, greatest(p - r, 0) AS p FROM c WHERE r <> p),
sp AS (SELECT DISTINCT network, species FROM c),
rx AS (SELECT DISTINCT network, reaction FROM c),
cl AS (
  SELECT network, reaction, CAST(4 * least(sum(r), 3) + least(sum(p), 3) AS INTEGER) AS class
  FROM c GROUP BY 1, 2),
clw AS (
  SELECT rx.network, rx.reaction, CAST(4 * least(coalesce(sum(r), 0), 3) + least(coalesce(sum(p), 0), 3) AS INTEGER) AS class
  FROM rx LEFT JOIN w USING (network, reaction) GROUP BY 1, 2),
sz AS (
  SELECT network, count(DISTINCT species) AS n_species, count(DISTINCT reaction) AS n_reactions FROM c GROUP BY 1),
ref AS (SELECT network FROM sz WHERE n_reactions <= {MOST}),
tgt AS (SELECT network FROM sz WHERE n_reactions > {MOST})"""

ORACLES: dict[str, str] = {}


def _add(name: str, select: str, *ctes: str) -> None:
    ORACLES[name] = "WITH RECURSIVE " + ",\n".join([BASE, *ctes]) + "\n" + select


_add("crn_stoich", "SELECT * FROM c")
_add("crn_net", "SELECT network, reaction, species, p - r AS net FROM c")
_add("crn_weak_projection", "SELECT * FROM w")
_add("crn_reaction_profile", f"SELECT {_LABEL}[class + 1] AS label, count(*) AS n_reactions, count(DISTINCT network) AS n_networks FROM cl GROUP BY 1")
_add("reaction_class", f"SELECT network, reaction, CAST(100 * (class // 4) + class % 4 AS BIGINT) AS code, {_LABEL}[class + 1] AS label FROM cl")
_add("reaction_class_onehot", "SELECT network, reaction, " + ", ".join(f"CAST(class = {i} AS BIGINT) AS c{i}" for i in range(16)) + " FROM cl")
_add("class_histogram", f"SELECT {_LABEL}[i + 1] AS label, count(class) AS n FROM range(16) t(i) LEFT JOIN cl ON class = i GROUP BY 1")
_add("network_sizes", "SELECT * FROM sz")
_add("boundary_networks", "SELECT network, max(n) <= 1 AS is_boundary FROM (SELECT network, reaction, sum(r + p) AS n FROM c GROUP BY 1, 2) GROUP BY 1")
_add("reaction_autocatalysis", "SELECT DISTINCT network, reaction FROM c WHERE r * p > 0")
_add("species_autocatalysis", "SELECT network, species, count(*) AS n FROM c WHERE r * p > 0 GROUP BY 1, 2")
_add("species_role_counts", "SELECT network, species AS node, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(p) AS BIGINT) AS sum_p FROM c GROUP BY 1, 2")
_add("species_bitvectors", "SELECT network, species AS node, coalesce(bit_or(1::BIGINT << class) FILTER (r > 0), 0) AS r, coalesce(bit_or(1::BIGINT << class) FILTER (p > 0), 0) AS p FROM c JOIN cl USING (network, reaction) GROUP BY 1, 2")
_add("species_role_class_counts", "SELECT network, species AS node, " + ", ".join(f"count(*) FILTER ({x} > 0 AND class = {i}) AS {x}_{i}" for x in "rp" for i in range(16)) + " FROM c JOIN cl USING (network, reaction) GROUP BY 1, 2")

_STEPS = """
rs1 AS (SELECT DISTINCT x.network, x.reaction AS a, y.reaction AS b FROM c x JOIN c y ON x.network = y.network AND x.species = y.species AND x.p > 0 AND y.r > 0),
rs2 AS (SELECT DISTINCT x.network, x.a, y.b FROM rs1 x JOIN rs1 y ON x.network = y.network AND x.b = y.a),
ss1 AS (SELECT DISTINCT x.network, x.species AS a, y.species AS b FROM c x JOIN c y ON x.network = y.network AND x.reaction = y.reaction AND x.r > 0 AND y.p > 0),
ss2 AS (SELECT DISTINCT x.network, x.a, y.b FROM ss1 x JOIN ss1 y ON x.network = y.network AND x.b = y.a),
sw AS (SELECT network, species AS t, class, sum(r) AS w FROM c JOIN cl USING (network, reaction) WHERE r > 0 GROUP BY 1, 2, 3)"""
_RF = "rf AS (" + " UNION ALL ".join(
    f"SELECT x.network, x.{a} AS node, '{n}{k}_' || class AS feature, count(*) AS value FROM rs{k} x JOIN cl ON cl.network = x.network AND cl.reaction = x.{b} GROUP BY 1, 2, 3"
    for k in (1, 2) for n, a, b in (("s", "a", "b"), ("p", "b", "a"))
) + ")"
_SF = "sf AS (" + " UNION ALL ".join(
    f"SELECT x.network, x.{a} AS node, '{n}{k}_' || class AS feature, CAST(sum(w) AS BIGINT) AS value FROM ss{k} x JOIN sw ON sw.network = x.network AND sw.t = x.{b} GROUP BY 1, 2, 3"
    for k in (1, 2) for n, a, b in (("s", "a", "b"), ("p", "b", "a"))
) + ")"
_SR = "sr AS (" + " UNION ALL ".join(f"SELECT network, species AS node, '{x}_' || class AS feature, count(*) AS value FROM c JOIN cl USING (network, reaction) WHERE {x} > 0 GROUP BY 1, 2, 3" for x in "rp") + ")"
_add("reaction_one_step", "SELECT * FROM rs1", _STEPS)
_add("species_one_step", "SELECT * FROM ss1", _STEPS)
_add(
    "reaction_degree_steps",
    "SELECT network, reaction AS node, " + ", ".join(f"(SELECT count(*) FROM rs{k} x WHERE x.network = rx.network AND x.{a} = rx.reaction) AS {n}_{k}" for n, a in (("s", "a"), ("p", "b")) for k in (1, 2)) + " FROM rx",
    _STEPS,
)
_add("reaction_nstep_features", "SELECT * FROM rf", _STEPS, _RF)
_add("species_nstep_features", "SELECT * FROM sf", _STEPS, _SF)
for _name, _t in (("bipartite_edges", "c"), ("bipartite_edges_weak", "w")):
    _add(
        _name,
        f"SELECT network, species AS src, CAST(reaction AS VARCHAR) AS dst, CAST(unnest(generate_series(1, r)) AS BIGINT) AS nth FROM {_t} WHERE r > 0 "
        f"UNION ALL SELECT network, CAST(reaction AS VARCHAR), species, CAST(unnest(generate_series(1, p)) AS BIGINT) FROM {_t} WHERE p > 0",
    )
_TERM = "string_agg(CASE WHEN {x} = 1 THEN species ELSE {x} || '.0 ' || species END, ' + ' ORDER BY species) FILTER ({x} > 0)"
_add("pretty_reactions", f"SELECT network, reaction, reaction || ': ' || coalesce({_TERM.format(x='r')}, '') || ' -> ' || coalesce({_TERM.format(x='p')}, '') AS text FROM c GROUP BY 1, 2")
_add("matrix_transpose", "SELECT network, CAST(reaction AS VARCHAR) AS row, species AS col, r AS value FROM c")
_add("zero_row_filter", "SELECT network, species AS row, reaction AS col, p - r AS value FROM c WHERE (network, species) IN (SELECT (network, species) FROM c WHERE p <> r)")
_add(
    "matrix_vmerge",
    "SELECT rows.network, rows.row, cols.col, coalesce(m.value, 0) AS value FROM (SELECT DISTINCT network, row FROM m) rows JOIN (SELECT DISTINCT network, col FROM m) cols USING (network) "
    "LEFT JOIN m ON m.network = rows.network AND m.row = rows.row AND m.col = cols.col",
    "m AS (SELECT network, species AS row, 'r' AS col, CAST(sum(r) AS BIGINT) AS value FROM c WHERE r > 0 GROUP BY 1, 2 UNION ALL SELECT network, species, 'p', CAST(sum(p) AS BIGINT) FROM c WHERE p > 0 GROUP BY 1, 2)",
)
_DENSE = """
sn AS (SELECT network, species, dense_rank() OVER (PARTITION BY network ORDER BY species) - 1 AS i FROM sp),
rn AS (SELECT network, reaction, dense_rank() OVER (PARTITION BY network ORDER BY reaction) - 1 AS j FROM rx),
dk AS (SELECT sz.network, n_species || '|' || n_reactions || '|' || coalesce(string_agg(i || ',' || j || ',' || r || ',' || p, ';' ORDER BY i, j), '') AS key
  FROM sz LEFT JOIN (SELECT * FROM {t} JOIN sn USING (network, species) JOIN rn USING (network, reaction)) x USING (network) GROUP BY sz.network, n_species, n_reactions)"""
for _name, _t in (("matrix_equal_strong", "c"), ("matrix_equal_weak", "w")):
    _add(_name, "SELECT network, min(network) OVER (PARTITION BY key) AS leader FROM dk", _DENSE.format(t=_t))
_KEY = """
rk AS (SELECT network, 1 AS side, species AS node, coalesce(string_agg(p - r, ',' ORDER BY p - r) FILTER (p <> r), '') AS x FROM c GROUP BY 1, 3
  UNION ALL SELECT network, 2, CAST(reaction AS VARCHAR), coalesce(string_agg(p - r, ',' ORDER BY p - r) FILTER (p <> r), '') FROM c GROUP BY 1, 3),
hk AS (SELECT network, n_species || '|' || n_reactions || '|' || string_agg(x, ';' ORDER BY x) FILTER (side = 1) || '|' || string_agg(x, ';' ORDER BY x) FILTER (side = 2) AS key
  FROM rk JOIN sz USING (network) GROUP BY network, n_species, n_reactions)"""
_add("network_hash_key", "SELECT network, key FROM hk", _KEY)
_add("hash_buckets", "SELECT key, count(*) AS n, min(network) AS first_network FROM hk GROUP BY 1", _KEY)
_add("hash_collisions", "SELECT CAST(sum(n) AS BIGINT) AS num_network, count(*) FILTER (n > 1) AS num_shared, count(*) AS num_unique_hash, max(n) AS max_network_in_hash FROM (SELECT count(*) AS n FROM hk GROUP BY key)", _KEY)

_COMPAT = """
need AS (SELECT network, {node}, count(*) AS k FROM {f} WHERE network IN (FROM ref) GROUP BY 1, 2),
met AS (
  SELECT x.network AS reference, x.node AS a, y.network AS target, y.node AS b, count(*) AS k
  FROM {f} x JOIN {f} y ON x.feature = y.feature AND y.value >= x.value
  WHERE x.network IN (FROM ref) AND y.network IN (FROM tgt) GROUP BY 1, 2, 3, 4)"""
_add(
    "reaction_compat",
    """SELECT x.network AS reference, x.reaction, y.network AS target, count(*) AS n
FROM (SELECT * FROM cl WHERE network IN (FROM ref)) x JOIN (SELECT * FROM cl WHERE network IN (FROM tgt)) y ON x.class = y.class
LEFT JOIN need ON need.network = x.network AND need.node = x.reaction
LEFT JOIN met ON met.reference = x.network AND met.a = x.reaction AND met.target = y.network AND met.b = y.reaction
WHERE coalesce(need.k, 0) = coalesce(met.k, 0) GROUP BY 1, 2, 3""",
    _STEPS, _RF, _COMPAT.format(f="rf", node="node"),
)
_add(
    "species_compat",
    """SELECT x.network AS reference, x.species, y.network AS target, count(*) AS n
FROM (SELECT * FROM sp WHERE network IN (FROM ref)) x CROSS JOIN (SELECT * FROM sp WHERE network IN (FROM tgt)) y
LEFT JOIN need ON need.network = x.network AND need.node = x.species
LEFT JOIN met ON met.reference = x.network AND met.a = x.species AND met.target = y.network AND met.b = y.species
WHERE coalesce(need.k, 0) = coalesce(met.k, 0) GROUP BY 1, 2, 3""",
    _STEPS, _SF, _SR, "af AS (SELECT network, node, 'n' || feature AS feature, value FROM sf UNION ALL SELECT network, node, 'c' || feature, value FROM sr)", _COMPAT.format(f="af", node="node"),
)
_add(
    "reaction_compat_equality",
    """SELECT x.network AS reference, x.node AS reaction, count(*) AS n FROM fk x JOIN fk y ON x.key = y.key
WHERE x.network IN (FROM ref) AND y.network IN (FROM tgt) GROUP BY 1, 2""",
    _STEPS, _RF, "fk AS (SELECT cl.network, cl.reaction AS node, class || '|' || coalesce(string_agg(feature || '=' || value, ',' ORDER BY feature), '') AS key FROM cl LEFT JOIN rf ON rf.network = cl.network AND rf.node = cl.reaction GROUP BY 1, 2, class)",
)
_add(
    "explain_incompatible",
    """SELECT wt.reference, wt.target, wt.ref_node, x.feature, x.value AS ref_value,
       (SELECT count(*) FROM ff y WHERE y.network = wt.target AND y.feature = x.feature AND CASE WHEN x.feature = 'z:class' THEN y.value = x.value ELSE y.value >= x.value END) AS n_fit
FROM wt JOIN ff x ON x.network = wt.reference AND x.node = wt.ref_node
QUALIFY row_number() OVER (PARTITION BY wt.reference, wt.target ORDER BY n_fit, x.feature) = 1""",
    _STEPS, _RF, _COMPAT.format(f="rf", node="node"),
    """cp AS (SELECT DISTINCT x.network AS reference, x.reaction, y.network AS target
FROM (SELECT * FROM cl WHERE network IN (FROM ref)) x JOIN (SELECT * FROM cl WHERE network IN (FROM tgt)) y ON x.class = y.class
LEFT JOIN need ON need.network = x.network AND need.node = x.reaction
LEFT JOIN met ON met.reference = x.network AND met.a = x.reaction AND met.target = y.network AND met.b = y.reaction
WHERE coalesce(need.k, 0) = coalesce(met.k, 0))""",
    "wt AS MATERIALIZED (SELECT x.network AS reference, t.network AS target, min(x.reaction) AS ref_node FROM rx x CROSS JOIN tgt t WHERE x.network IN (FROM ref) AND NOT EXISTS (FROM cp WHERE cp.reference = x.network AND cp.reaction = x.reaction AND cp.target = t.network) GROUP BY 1, 2)",
    "ff AS MATERIALIZED (SELECT network, node, 'y:' || feature AS feature, value FROM rf UNION ALL SELECT network, reaction, 'z:class', class + 1 FROM cl)",
)
_NC = "nc AS (SELECT x.network AS reference, x.reaction, x.class, y.network AS target, count(*) AS n FROM cl x JOIN cl y ON x.class = y.class WHERE x.network IN (FROM ref) AND y.network IN (FROM tgt) GROUP BY 1, 2, 3, 4)"
_add(
    "candidate_log10",
    "SELECT reference, target, round(CASE WHEN count(*) = n_reactions THEN sum(log10(n)) END, 6) AS log10_n FROM nc JOIN sz ON sz.network = reference GROUP BY reference, target, n_reactions",
    _NC,
)
_add(
    "no_constraint_log10",
    """SELECT a.k, b.n, a.n_refs, b.n_tgts, round((SELECT sum(log10(i)) FROM range(b.n - a.k + 1, b.n + 1) t(i)), 6) AS log10_n
FROM (SELECT n_reactions AS k, count(*) AS n_refs FROM sz JOIN ref USING (network) GROUP BY 1) a CROSS JOIN (SELECT n_reactions AS n, count(*) AS n_tgts FROM sz JOIN tgt USING (network) GROUP BY 1) b""",
)
_add("candidate_percentiles", f"SELECT {_LABEL}[class + 1] AS label, " + ", ".join(f"quantile_cont(n, {q / 100}) AS p{q}" for q in (10, 50, 90)) + " FROM nc GROUP BY 1", _NC)

#: Mappings: of pairs with shapes enough, choose the images of the reactions one by one, group species by their stoichiometry there, count the ways to map groups.
_MAP = """
sh AS (SELECT rx.network, rx.reaction, class || '|' || coalesce(string_agg(r || ':' || p, ',' ORDER BY r, p) FILTER (r > 0), '') AS shape FROM rx JOIN {cl} USING (network, reaction) LEFT JOIN {t} c USING (network, reaction) GROUP BY 1, 2, class),
rl AS MATERIALIZED (SELECT network, reaction, shape, row_number() OVER (PARTITION BY network ORDER BY reaction) AS o FROM sh WHERE network IN (FROM ref)),
tl AS MATERIALIZED (SELECT * FROM sh WHERE network IN (FROM tgt)),
kr AS (SELECT network, shape, count(*) AS k, count(*) OVER (PARTITION BY network) AS all_k FROM rl GROUP BY 1, 2), kt AS (SELECT network, shape, count(*) AS m FROM tl GROUP BY 1, 2),
fit AS MATERIALIZED (
  SELECT kr.network AS reference, kt.network AS target FROM kr JOIN kt USING (shape) WHERE m >= k GROUP BY 1, 2 HAVING count(*) = any_value(all_k)),
im AS (
  SELECT reference, target, 0 AS o, []::BIGINT[] AS ys FROM fit
  UNION ALL SELECT im.reference, im.target, im.o + 1, list_append(ys, tl.reaction) FROM im JOIN rl ON rl.network = im.reference AND rl.o = im.o + 1
  JOIN tl ON tl.network = im.target AND tl.shape = rl.shape AND NOT list_contains(ys, tl.reaction)),
a3 AS MATERIALIZED (SELECT reference, target, ys, reference || ':' || target || ':' || ys::VARCHAR AS aid FROM im JOIN sz ON sz.network = reference WHERE o = n_reactions),
ch AS MATERIALIZED (SELECT aid, reference, target, rl.o, rl.reaction AS x, ys[rl.o] AS y FROM a3 JOIN rl ON rl.network = reference),
rv AS (SELECT aid, species, string_agg(o || ':' || r || ':' || p, ',' ORDER BY o) AS v, max(r) > 0 AS closed FROM ch JOIN {t} c ON c.network = reference AND c.reaction = x GROUP BY 1, 2),
tv AS (SELECT aid, species, string_agg(o || ':' || r || ':' || p, ',' ORDER BY o) AS v, max(r) > 0 AS closed FROM ch JOIN {t} c ON c.network = target AND c.reaction = y GROUP BY 1, 2),
rg AS (SELECT aid, v, closed, count(*) AS n FROM rv GROUP BY 1, 2, 3), tg AS (SELECT aid, v, closed, count(*) AS m FROM tv GROUP BY 1, 2, 3),
gg AS (SELECT aid, v, coalesce(rg.closed, tg.closed) AS closed, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM rg FULL JOIN tg USING (aid, v)),
z AS (
  SELECT a3.aid, any_value(a3.reference) AS reference, any_value(a3.target) AS target,
         any_value(rs.n_species) - coalesce(sum(n), 0) AS n0, any_value(ts.n_species) - coalesce(sum(m), 0) AS m0,
         coalesce(bool_and(CASE WHEN closed THEN n = m ELSE n <= m END), true) AS ok,
         coalesce(product(CASE WHEN n <= m THEN round(gamma(m + 1) / gamma(m - n + 1)) ELSE 0 END), 1) AS ways
  FROM a3 JOIN sz rs ON rs.network = a3.reference JOIN sz ts ON ts.network = a3.target LEFT JOIN gg ON gg.aid = a3.aid GROUP BY a3.aid),
mp AS (
  SELECT reference, target, CAST(sum(round(ways * round(gamma(m0 + 1) / gamma(m0 - n0 + 1)))) AS BIGINT) AS n_pairs
  FROM z WHERE ok AND n0 <= m0 GROUP BY 1, 2)"""
_STRONG = _MAP.format(cl="cl", t="c")
_NAMED = "CAST(reference AS VARCHAR) AS reference, CAST(target AS VARCHAR) AS target"
_add("mapping_pairs_strong", f"SELECT {_NAMED}, n_pairs FROM mp", _STRONG)
_add("mapping_pairs_weak", f"SELECT {_NAMED}, n_pairs FROM mp", _MAP.format(cl="clw", t="w"))
_add(
    "inferred_networks",
    f"""SELECT {_NAMED}, n_reactions, CAST((SELECT sum(r + p) FROM c WHERE c.network = reference) AS BIGINT) AS total
FROM mp JOIN sz ON sz.network = reference""",
    _STRONG,
)
_add(
    "finder_table",
    """SELECT CAST(ref.network AS VARCHAR) AS reference_name, CAST(tgt.network AS VARCHAR) AS target_name, coalesce(n_pairs, 0) AS num_mapping_pair, false AS is_truncated
FROM ref CROSS JOIN tgt LEFT JOIN mp ON reference = ref.network AND target = tgt.network""",
    _STRONG,
)
_add(
    "finder_summary",
    """SELECT (SELECT count(*) FROM ref) * (SELECT count(*) FROM tgt) AS n, count(*) AS n_found, CAST(0 AS BIGINT) AS n_truncated,
       (SELECT count(*) FROM ref) AS n_references, count(DISTINCT reference) AS n_references_found FROM mp""",
    _STRONG,
)
_add("targets_per_reference_histogram", "SELECT n_targets, count(*) AS n_references FROM (SELECT reference, count(*) AS n_targets FROM mp GROUP BY 1) GROUP BY 1", _STRONG)
_add(
    "reaction_assignments",
    """SELECT reference, target, CAST(product(ways) AS BIGINT) AS n FROM (
  SELECT x.network AS reference, y.network AS target, round(gamma(y.n + 1) / gamma(y.n - x.n + 1)) AS ways FROM k x JOIN k y USING (class)
  WHERE x.network IN (FROM ref) AND y.network IN (FROM tgt) AND x.n <= y.n) g
GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM k WHERE k.network = g.reference)""",
    "k AS (SELECT network, class, count(*) AS n FROM cl GROUP BY 1, 2)",
)
_add("closure_filter", "SELECT network, reaction, max(n) = 1 AS is_closed FROM (SELECT network, reaction, count(*) OVER (PARTITION BY network, species) AS n FROM c WHERE r > 0) GROUP BY 1, 2")
_add("pending_pairs_antijoin", "SELECT ref.network AS reference, tgt.network AS target FROM ref CROSS JOIN tgt WHERE (ref.network + tgt.network) % 2 <> 0")
_add("collection_union", "SELECT * FROM sz")
_add("collection_intersect_check", "SELECT network FROM sz WHERE n_reactions = 6")
_add(
    "summary_stats",
    """SELECT n_reactions, round(avg(total), 6) AS mean, round(stddev_pop(total), 6) AS std_pop, min(total) AS least, max(total) AS greatest, count(*) AS n, CAST(sum(total) AS BIGINT) AS total
FROM (SELECT network, CAST(sum(r + p) AS BIGINT) AS total FROM c GROUP BY 1) JOIN sz USING (network) GROUP BY 1""",
)
_add("model_summary_median", "SELECT network, median(r) AS r, median(p) AS p, n_species, n_reactions FROM (SELECT network, reaction, CAST(sum(r) AS BIGINT) AS r, CAST(sum(p) AS BIGINT) AS p FROM c GROUP BY 1, 2) JOIN sz USING (network) GROUP BY network, n_species, n_reactions")
for _name, _dir in (("dedupe_first", "ASC"), ("dedupe_last", "DESC")):
    _add(_name, f"SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY network, species ORDER BY reaction {_dir}) = 1")
_CHANCE = "pc AS (SELECT network, n_species, n_reactions, count(*) OVER (PARTITION BY key, n_species, n_reactions) / count(*) OVER (PARTITION BY n_species, n_reactions) AS p FROM hk JOIN sz USING (network))"
_add(
    "estimated_poc",
    "SELECT reference, target, round(1 - pow(1 - p, t.n_reactions / r.n_reactions), 6) AS estimated FROM mp JOIN pc ON pc.network = reference JOIN sz r ON r.network = reference JOIN sz t ON t.network = target",
    _STRONG, _KEY, _CHANCE,
)
_add(
    "poc_pivot",
    "SELECT n_reactions, " + ", ".join(f"round(median(0.0 - log10(greatest(p, 1e-5))) FILTER (n_species = {i}), 6) AS s{i}" for i in range(1, 7)) + " FROM pc GROUP BY 1",
    _KEY, _CHANCE,
)
_add(
    "cluster_subset_violations",
    """SELECT a.cluster, a.network FROM wl a JOIN sl b USING (network) JOIN sl l ON l.network = a.cluster WHERE b.cluster <> l.cluster""",
    _DENSE.format(t="c"), "sl AS (SELECT network, min(network) OVER (PARTITION BY key) AS cluster FROM dk)",
    _DENSE.format(t="w").replace("sn AS", "sn2 AS").replace("rn AS", "rn2 AS").replace("dk AS", "dk2 AS"), "wl AS (SELECT network, min(network) OVER (PARTITION BY key) AS cluster FROM dk2)",
)
_add("size_grid_counts", "SELECT n_species, n_reactions, count(*) AS n FROM sz GROUP BY 1, 2")
_add("count_distribution", "SELECT n_reactions, CAST(at_most AS BIGINT) AS at_most, round(at_most / (SELECT count(*) FROM sz), 6) AS share FROM (SELECT n_reactions, sum(count(*)) OVER (ORDER BY n_reactions) AS at_most FROM sz GROUP BY 1)")
_PRETTY = f"pr AS (SELECT network, reaction, reaction || ': ' || coalesce({_TERM.format(x='r')}, '') || ' -> ' || coalesce({_TERM.format(x='p')}, '') AS text FROM c GROUP BY 1, 2)"
_add("pretty_networks", "SELECT network, network || ': ' || n_species || ' species, ' || n_reactions || ' reactions' || string_agg(chr(10) || '   ' || text, '' ORDER BY reaction) AS text FROM pr JOIN sz USING (network) GROUP BY network, n_species, n_reactions", _PRETTY)
_add(
    "edge_list_text",
    "SELECT network, string_agg(line, chr(10) ORDER BY part, line) AS text FROM e GROUP BY 1",
    "e AS (SELECT network, 0 AS part, species || '>' || reaction AS line FROM (SELECT network, species, reaction, unnest(generate_series(1, r)) FROM c WHERE r > 0) "
    "UNION ALL SELECT network, 0, reaction || '>' || species FROM (SELECT network, species, reaction, unnest(generate_series(1, p)) FROM c WHERE p > 0) "
    "UNION ALL SELECT network, 1, species || ',,species' FROM sp UNION ALL SELECT network, 1, reaction || ',,reaction' FROM rx)",
)
_add("matrix_sort_names", "SELECT network, species AS row, CAST(reaction AS VARCHAR) AS col, p AS value, dense_rank() OVER (PARTITION BY network ORDER BY species) - 1 AS row_no, dense_rank() OVER (PARTITION BY network ORDER BY CAST(reaction AS VARCHAR)) - 1 AS col_no FROM c")
_add("matrix_vstack", "SELECT network, '0:' || species AS row, CAST(reaction AS VARCHAR) AS col, r AS value FROM c UNION ALL SELECT network, '1:' || species, CAST(reaction AS VARCHAR), p FROM c")
_add("catalyst_free", "SELECT network, count(*) FILTER (r * p > 0) = 0 AS is_free FROM c GROUP BY 1")
ORACLES["finder_two_phase"] = ORACLES["finder_table"]
ORACLES["finder_found_only"] = ORACLES["mapping_pairs_weak"]
_add("bucket_members", "SELECT dense_rank() OVER (ORDER BY cluster) - 1 AS collection_idx, cluster, network FROM (SELECT network, min(network) OVER (PARTITION BY key) AS cluster, count(*) OVER (PARTITION BY key) AS n FROM hk) WHERE n > 1", _KEY)
_add("size_quantiles", "SELECT n_reactions, n, round(cume_dist() OVER (ORDER BY n_reactions), 6) AS share FROM (SELECT n_reactions, count(*) AS n FROM sz GROUP BY 1)")
_add("network_pairs_by_key", "SELECT a.network AS reference, b.network AS target FROM hk a JOIN hk b ON a.key = b.key AND a.network < b.network", _KEY)
