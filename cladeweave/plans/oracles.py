"""DuckDB SQL for the queries, written apart from the operators."""

from __future__ import annotations

_SNPS = """
snps_fx AS (
  SELECT CAST(vec_id % 12 AS INTEGER) AS sample_idx, vec_id // 12 AS locus, (vec_id // 12) * 64 + pos AS site,
    CAST(CASE WHEN (vec_id * 31 + pos * 17) % 23 = 0 THEN 78 WHEN (vec_id * 13 + pos * 7) % 29 = 0 THEN 82
      WHEN v < -0.125 THEN 65 WHEN v < 0 THEN 67 WHEN v < 0.125 THEN 71 ELSE 84 END AS INTEGER) AS base
  FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos FROM embeddings))"""


def _draw(*keys: str) -> str:
    return "CAST(('0x' || substr(md5(concat_ws(':', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")), 1, 8)) AS BIGINT)"


def _order(*keys: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "))"


def _coin(base: str, *keys: str) -> str:
    pairs = {82: (71, 65), 75: (71, 84), 83: (71, 67), 89: (84, 67), 87: (84, 65), 77: (67, 65)}
    whens = " ".join(f"WHEN {base} = {c} THEN CASE WHEN {_draw(*keys)} % 2 = 1 THEN {a} ELSE {b} END" for c, (a, b) in pairs.items())
    return f"CAST(CASE {whens} WHEN {base} = 45 THEN 78 ELSE {base} END AS INTEGER)"


_CODE = "CAST(CASE base WHEN 65 THEN 0 WHEN 67 THEN 1 WHEN 71 THEN 2 WHEN 84 THEN 3 END AS INTEGER)"
_RESOLVED = f"resolved AS (SELECT sample_idx, locus, site, {_coin('base', '7', '0', 'sample_idx', 'site')} AS base FROM snps_fx)"
_CODES = f"{_SNPS}, {_RESOLVED}, codes AS (SELECT sample_idx, locus, site, {_CODE} AS code FROM resolved)"
_PATTERNS = f"""{_CODES},
patterns AS (
  SELECT a.sample_idx AS i0, b.sample_idx AS i1, c.sample_idx AS i2, d.sample_idx AS i3, a.locus, a.site, a.code * 4 + b.code AS r, c.code * 4 + d.code AS c
  FROM codes a JOIN codes b ON a.site = b.site AND a.sample_idx < b.sample_idx JOIN codes c ON a.site = c.site AND b.sample_idx < c.sample_idx
  JOIN codes d ON a.site = d.site AND c.sample_idx < d.sample_idx
  WHERE a.code IS NOT NULL AND b.code IS NOT NULL AND c.code IS NOT NULL AND d.code IS NOT NULL AND NOT (a.code = b.code AND b.code = c.code AND c.code = d.code))"""
_UNLINKED = f"""{_PATTERNS},
firsts AS (SELECT *, row_number() OVER (PARTITION BY i0, i1, i2, i3, locus ORDER BY site) AS k FROM patterns),
unlinked AS (SELECT i0, i1, i2, i3, r, c, count(*) AS n FROM firsts WHERE k = 1 GROUP BY ALL)"""
_RANKS = """
idx AS (SELECT CAST(i AS INTEGER) AS i FROM range(12) t(i)),
ranks AS (
  SELECT row_number() OVER (ORDER BY a.i, b.i, c.i, d.i) - 1 AS rank, a.i AS i0, b.i AS i1, c.i AS i2, d.i AS i3
  FROM idx a JOIN idx b ON a.i < b.i JOIN idx c ON b.i < c.i JOIN idx d ON c.i < d.i)"""
_QUARTETS = f"""{_RANKS},
grouped AS (
  SELECT CAST(l_linenumber % 4 AS INTEGER) AS rep, l_orderkey % 495 AS qid,
    coalesce(min(l_extendedprice) FILTER (l_returnflag = 'A'), 0.001) AS s0, coalesce(min(l_extendedprice) FILTER (l_returnflag = 'N'), 0.001) AS s1,
    coalesce(min(l_extendedprice) FILTER (l_returnflag = 'R'), 0.001) AS s2, count(*) AS nsnps
  FROM lineitem GROUP BY 1, 2),
quartets_fx AS (
  SELECT rep, i0, i1, i2, i3, s0, s1, s2, CAST(CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS INTEGER) AS res, nsnps,
    least(s0, s1, s2) AS lo, (s0 + s1 + s2 - least(s0, s1, s2)) / 2 AS upper
  FROM grouped JOIN ranks ON grouped.qid = ranks.rank)"""
_EDGES = """
edges(edge_id, a, b, c, d) AS (VALUES
  (0, [2], [3], [0, 1], [4, 5, 6, 7, 8, 9, 10, 11]),
  (1, [4], [5], [6, 7], [0, 1, 2, 3, 8, 9, 10, 11]),
  (2, [6], [7], [4, 5], [0, 1, 2, 3, 8, 9, 10, 11]),
  (3, [8], [9], [10, 11], [0, 1, 2, 3, 4, 5, 6, 7]),
  (4, [10], [11], [8, 9], [0, 1, 2, 3, 4, 5, 6, 7]),
  (5, [4, 5], [6, 7], [0, 1, 2, 3], [8, 9, 10, 11]),
  (6, [8, 9], [10, 11], [0, 1, 2, 3], [4, 5, 6, 7]),
  (7, [0, 1], [2, 3], [4, 5, 6, 7], [8, 9, 10, 11]),
  (8, [0], [1], [2, 3], [4, 5, 6, 7, 8, 9, 10, 11])),
ea AS (SELECT edge_id, unnest(a) AS x FROM edges), eb AS (SELECT edge_id, unnest(b) AS x FROM edges),
ec AS (SELECT edge_id, unnest(c) AS x FROM edges), ed AS (SELECT edge_id, unnest(d) AS x FROM edges),
products AS (
  SELECT ea.edge_id, list_sort([ea.x, eb.x, ec.x, ed.x]) AS q, ea.x AS a, eb.x AS b, ec.x AS c, ed.x AS d
  FROM ea JOIN eb USING (edge_id) JOIN ec USING (edge_id) JOIN ed USING (edge_id)),
tree_q AS (
  SELECT q[1] AS i0, q[2] AS i1, q[3] AS i2, q[4] AS i3, CAST(edge_id AS INTEGER) AS edge_id,
    CAST(list_position(q, CASE q[1] WHEN a THEN b WHEN b THEN a WHEN c THEN d ELSE c END) - 2 AS INTEGER) AS r
  FROM products)"""


def _mapped(min_snps: int, min_ratio: float) -> str:
    return f"""{_QUARTETS}, {_EDGES},
scored AS (
  SELECT f.*, t.r, t.edge_id, CASE WHEN lo = 0 THEN 0.0 ELSE upper / lo END AS score
  FROM quartets_fx f JOIN tree_q t ON f.i0 = t.i0 AND f.i1 = t.i1 AND f.i2 = t.i2 AND f.i3 = t.i3),
mapped AS (
  SELECT *, NOT (score < {min_ratio} OR nsnps < {min_snps}) AS informative,
    CASE WHEN res = r THEN 0 WHEN res = (CASE r WHEN 0 THEN 1 ELSE 0 END) THEN 1 ELSE 2 END AS kind
  FROM scored)"""


def _tallies(keys: str = "") -> str:
    told = ", ".join(f"count(*) FILTER (informative AND kind = {k}) AS {n}" for k, n in ((0, "conc"), (1, "disc1"), (2, "disc2")))
    return f"SELECT {keys}edge_id, {told}, count(*) FILTER (NOT informative) AS nu, count(*) AS nqrts FROM mapped GROUP BY ALL"


_LOCI = f"""{_SNPS},
spans AS (SELECT locus, min(site) AS start, max(site) + 1 AS past, count(DISTINCT site) AS n_sites FROM snps_fx GROUP BY locus),
numbered AS (SELECT *, row_number() OVER (ORDER BY locus) - 1 AS number FROM spans)"""


def _drawn(reps: int) -> str:
    return f"""{_LOCI},
draws AS (
  SELECT CAST(rep AS BIGINT) AS rep, CAST(rlocus AS BIGINT) AS rlocus, {_draw('7', 'rep', 'rlocus')} % (SELECT count(*) FROM spans) AS number
  FROM range(1, {reps + 1}) x(rep), range(CAST((SELECT count(*) FROM spans) AS BIGINT)) y(rlocus)),
drawn AS (SELECT rep, rlocus, locus, n_sites FROM draws JOIN numbered USING (number))"""


def _random(rep: int) -> str:
    ranks = _RANKS.replace("range(12)", "range((SELECT count(*) FROM benchmark))")
    return f"{ranks}, chosen AS (SELECT * FROM ranks ORDER BY {_order('7', str(rep), 'rank')}, rank LIMIT (SELECT count(*) FROM customer))"


_ASKED = """
many AS (SELECT CAST(i AS INTEGER) AS i FROM range(60) t(i)),
every AS (
  SELECT row_number() OVER (ORDER BY a.i, b.i, c.i, d.i) - 1 AS rank, a.i AS i0, b.i AS i1, c.i AS i2, d.i AS i3
  FROM many a JOIN many b ON a.i < b.i JOIN many c ON b.i < c.i JOIN many d ON c.i < d.i),
asked_q AS (SELECT rank, i0, i1, i2, i3 FROM (SELECT DISTINCT (l_orderkey * 7919 + l_partkey * 31) % 487635 AS rank FROM lineitem) JOIN every USING (rank))"""


_TREES = (
    ("0,1", "2,3", "0,1,2,3", "4,5", "6,7", "4,5,6,7", "0,1,2,3,4,5,6,7", "8,9", "10,11", "8,9,10,11"),
    ("0,1", "2,3", "0,1,2,3", "4,6", "5,7", "4,5,6,7", "0,1,2,3,4,5,6,7", "8,9", "10,11", "8,9,10,11"),
    ("0,2", "1,3", "0,1,2,3", "4,5", "6,7", "4,5,6,7", "0,1,2,3,4,5,6,7", "8,10", "9,11", "8,9,10,11"),
    ("0,1", "0,1,2", "0,1,2,3", "4,5", "6,7", "4,5,6,7", "0,1,2,3,4,5,6,7", "8,9", "10,11", "8,9,10,11"),
)
_SIDES = (
    "given(tree_id, side) AS (VALUES "
    + ", ".join(f"({t}, [{s}])" for t, sides in enumerate(_TREES) for s in sides)
    + """),
canon AS (
  SELECT DISTINCT tree_id, list_sort(CASE WHEN list_contains(side, 0) THEN list_filter(range(12), lambda x: NOT list_contains(side, x)) ELSE side END) AS side FROM given),
freqs AS (SELECT array_to_string(side, ',') AS side, count(DISTINCT tree_id) AS n, count(DISTINCT tree_id) / 4.0 AS freq FROM canon GROUP BY 1)"""
)
_ORDER = ("2,3", "4,5", "6,7", "8,9", "10,11", "4,5,6,7", "8,9,10,11", "4,5,6,7,8,9,10,11", "2,3,4,5,6,7,8,9,10,11")


_MANY = _CODES.replace("% 12", "% 60").replace("// 12", "// 60") + f""",
many AS (SELECT CAST(i AS INTEGER) AS i FROM range(60) t(i)),
every AS (
  SELECT row_number() OVER (ORDER BY a.i, b.i, c.i, d.i) - 1 AS rank, a.i AS i0, b.i AS i1, c.i AS i2, d.i AS i3
  FROM many a JOIN many b ON a.i < b.i JOIN many c ON b.i < c.i JOIN many d ON c.i < d.i),
asked AS (SELECT i0, i1, i2, i3 FROM every ORDER BY {_order('7', '0', 'rank')}, rank LIMIT 200),
patterns AS (
  SELECT i0, i1, i2, i3, a.locus, a.site, a.code * 4 + b.code AS r, c.code * 4 + d.code AS c
  FROM asked JOIN codes a ON a.sample_idx = i0 JOIN codes b ON b.sample_idx = i1 AND b.site = a.site JOIN codes c ON c.sample_idx = i2 AND c.site = a.site
  JOIN codes d ON d.sample_idx = i3 AND d.site = a.site
  WHERE a.code IS NOT NULL AND b.code IS NOT NULL AND c.code IS NOT NULL AND d.code IS NOT NULL AND NOT (a.code = b.code AND b.code = c.code AND c.code = d.code))"""

_MANY_PATTERNS = _CODES.replace("% 12", "% 60").replace("// 12", "// 60") + """,
known AS (SELECT * FROM codes WHERE code IS NOT NULL),
all_patterns AS (
  SELECT a.sample_idx AS i0, b.sample_idx AS i1, c.sample_idx AS i2, d.sample_idx AS i3, a.code * 4 + b.code AS r, c.code * 4 + d.code AS c
  FROM known a JOIN known b ON a.site = b.site AND a.sample_idx < b.sample_idx JOIN known c ON a.site = c.site AND b.sample_idx < c.sample_idx
  JOIN known d ON a.site = d.site AND c.sample_idx < d.sample_idx WHERE NOT (a.code = b.code AND b.code = c.code AND c.code = d.code))"""

# splits of the fixed tree without the smallest tip, and the clades below the root of its rooting
_TREE_SIDES = ("2,3", "4,5", "6,7", "8,9", "10,11", "4,5,6,7", "8,9,10,11", "4,5,6,7,8,9,10,11", "2,3,4,5,6,7,8,9,10,11")
_TREE_CLADES = ("0,1", "2,3", "4,5", "6,7", "8,9", "10,11", "0,1,2,3", "4,5,6,7", "8,9,10,11", "0,1,2,3,4,5,6,7")


def _column(values) -> str:
    return ", ".join(f"('{v}')" for v in values)


ORACLES = {
    "encode_bases": f"WITH {_CODES} SELECT * FROM codes",
    "sample_names": "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS sample_idx, n_name AS name FROM nation WHERE n_nationkey < 12",
    "matrix_summary": f"WITH {_SNPS} SELECT count(DISTINCT sample_idx) AS n_samples, count(DISTINCT site) AS n_sites, count(DISTINCT locus) AS n_loci FROM snps_fx",
    "locus_spans": f"WITH {_LOCI} SELECT locus, start, past AS \"end\", n_sites FROM spans",
    "zero_based_loci": f"WITH {_SNPS} SELECT * FROM snps_fx",
    "quartets_all": f"WITH {_RANKS} SELECT i0, i1, i2, i3 FROM ranks",
    "quartets_unrank": f"WITH {_ASKED} SELECT rank, i0, i1, i2, i3 FROM asked_q",
    "quartets_random": f"WITH {_random(1)} SELECT rank, i0, i1, i2, i3 FROM chosen",
    "quartets_random_sorted": f"WITH {_random(2)} SELECT i0, i1, i2, i3, row_number() OVER (ORDER BY rank) - 1 AS place FROM chosen",
    "quartet_budget": """WITH asked AS (SELECT DISTINCT CAST(l_quantity * 12 AS INTEGER) AS n, l_partkey * l_linenumber - 50 AS k FROM lineitem),
sized AS (SELECT n, k, CAST(CAST(n AS HUGEINT) * (n - 1) * (n - 2) * (n - 3) // 24 AS BIGINT) AS total, CAST(floor(pow(n, 2.8)) AS BIGINT) AS rough FROM asked)
SELECT n AS n_samples, k AS wanted, total, rough, CAST(CASE WHEN k <= 0 THEN total ELSE least(k, total) END AS BIGINT) AS taken FROM sized WHERE total < 4294967295""",
    "pattern_counts_sampled": f"WITH {_MANY} SELECT i0, i1, i2, i3, r, c, count(*) AS n FROM patterns GROUP BY ALL",
    "pattern_counts_sampled_unlinked": f"""WITH {_MANY},
firsts AS (SELECT *, row_number() OVER (PARTITION BY i0, i1, i2, i3, locus ORDER BY site) AS k FROM patterns)
SELECT i0, i1, i2, i3, r, c, count(*) AS n FROM firsts WHERE k = 1 GROUP BY ALL""",
    "universe_totals": f"""WITH {_MANY_PATTERNS}
SELECT i0, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, count(*) AS quartets, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * ((i1 * 3600 + i2 * 60 + i3) % 1009)) AS BIGINT) AS marked
FROM (SELECT i0, i1, i2, i3, r, c, count(*) AS n FROM all_patterns GROUP BY ALL) GROUP BY i0, r, c""",
    "pattern_counts_interleaved": f"""WITH {_MANY},
firsts AS (SELECT *, row_number() OVER (PARTITION BY i0, i1, i2, i3, locus ORDER BY site % 64 * 37 % 64) AS k FROM patterns)
SELECT i0, i1, i2, i3, r, c, count(*) AS n FROM firsts WHERE k = 1 GROUP BY ALL""",
    "bootstrap_counts": f"""WITH {_drawn(20)},
weights AS (SELECT rep, locus, count(*) AS m FROM drawn GROUP BY ALL),
cells AS (SELECT rep, m, site, sample_idx, {_coin('base', '7', 'rep', 'sample_idx', 'site')} AS base FROM weights JOIN snps_fx USING (locus)),
codes AS (SELECT rep, m, site, sample_idx, {_CODE} AS code FROM cells),
known AS (SELECT * FROM codes WHERE code IS NOT NULL),
told AS (
  SELECT a.rep, a.sample_idx AS i0, b.sample_idx AS i1, c.sample_idx AS i2, d.sample_idx AS i3, (a.code * 4 + b.code) * 16 + c.code * 4 + d.code AS cell, sum(a.m) AS n
  FROM known a JOIN known b ON a.rep = b.rep AND a.site = b.site AND a.sample_idx < b.sample_idx JOIN known c ON a.rep = c.rep AND a.site = c.site AND b.sample_idx < c.sample_idx
  JOIN known d ON a.rep = d.rep AND a.site = d.site AND c.sample_idx < d.sample_idx
  WHERE NOT (a.code = b.code AND b.code = c.code AND c.code = d.code) GROUP BY ALL)
SELECT rep, i0, i1, i2, i3, CAST(sum(n) AS BIGINT) AS nsnps, CAST(sum(n * n) AS BIGINT) AS squares, CAST(sum(n * cell) AS BIGINT) AS checksum FROM told GROUP BY ALL""",
    "quartet_spans": f"""WITH {_QUARTETS}, sides(edge_id, side) AS (VALUES {", ".join(f"({i}, [{s}])" for i, s in enumerate(_ORDER))}),
cut AS (
  SELECT rep, i0, i1, i2, i3, edge_id, len(list_intersect(side, [i0, i1, i2, i3])) AS inside, list_contains(side, i0) = list_contains(side, i1) AS r0, list_contains(side, i0) = list_contains(side, i2) AS r1
  FROM quartets_fx, sides),
found AS (SELECT rep, i0, i1, i2, i3, count(*) AS span, min(CASE WHEN r0 THEN 0 WHEN r1 THEN 1 ELSE 2 END) AS r, min(edge_id) AS edge_id FROM cut WHERE inside = 2 GROUP BY ALL)
SELECT q.rep, q.i0, q.i1, q.i2, q.i3, CAST(r AS INTEGER) AS r, CAST(coalesce(span, 0) AS INTEGER) AS span, CAST(CASE WHEN span = 1 THEN edge_id END AS INTEGER) AS edge_id FROM quartets_fx q LEFT JOIN found USING (rep, i0, i1, i2, i3)""",
    "quartet_scores_known": f"""WITH {_RANKS},
lines AS (SELECT l_orderkey % 3 AS rep, l_orderkey % 495 AS qid, l_linenumber % 4 AS x, day(l_shipdate) % 4 AS y FROM lineitem),
xs AS (SELECT rep, qid, a, count(*) FILTER (x = a) + a + 1 AS m FROM lines, range(4) t(a) GROUP BY rep, qid, a),
ys AS (SELECT rep, qid, b, count(*) FILTER (y = b) + b + 1 AS k FROM lines, range(4) t(b) GROUP BY rep, qid, b),
cells AS (SELECT rep, qid, a, b, m * k AS n FROM xs JOIN ys USING (rep, qid)),
seen AS (SELECT rep, qid, sum(n) AS every, max(n) AS top, sum(n * n) AS squares FROM cells GROUP BY rep, qid)
SELECT rep, i0, i1, i2, i3, CAST(CASE rep WHEN 2 THEN 0 ELSE squares - top * top END AS BIGINT) AS s0_squared, CAST(CASE rep WHEN 0 THEN 0 ELSE squares - top * top END AS BIGINT) AS s1_squared,
  CAST(CASE rep WHEN 1 THEN 0 ELSE squares - top * top END AS BIGINT) AS s2_squared, CAST(CASE rep WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS res, CAST(every AS BIGINT) AS nsnps
FROM seen JOIN ranks ON qid = rank""",
    "singular_values": f"""WITH {_PATTERNS}, cells AS (SELECT i0, i1, i2, i3, r, c, count(*) AS n FROM patterns GROUP BY ALL)
SELECT i0, i1, i2, i3, CAST(f AS INTEGER) AS f, CAST(sum(n * n) AS DOUBLE) AS squares, CAST(sum(n) AS BIGINT) AS nsnps FROM cells, range(3) t(f) GROUP BY ALL""",
    "weightless_lines": f"""WITH {_QUARTETS} SELECT rep, CASE res WHEN 0 THEN format('{{}},{{}}|{{}},{{}}', i0, i1, i2, i3) WHEN 1 THEN format('{{}},{{}}|{{}},{{}}', i0, i2, i1, i3)
ELSE format('{{}},{{}}|{{}},{{}}', i0, i3, i1, i2) END || ':1.00000' AS line FROM quartets_fx WHERE nsnps >= 1 AND greatest(s0, s1, s2) > 0""",
    "shuffled_lines": f"""WITH {_QUARTETS}, lines AS (SELECT rep, CASE res WHEN 0 THEN format('{{}},{{}}|{{}},{{}}', i0, i1, i2, i3) WHEN 1 THEN format('{{}},{{}}|{{}},{{}}', i0, i2, i1, i3)
ELSE format('{{}},{{}}|{{}},{{}}', i0, i3, i1, i2) END || ':' || printf('%.5f', upper) AS line FROM quartets_fx WHERE CASE WHEN lo = 0 THEN 1.0 ELSE upper / lo END >= 1.0)
SELECT rep, line, {_order('7', 'line')} AS key FROM lines""",
    "supertree_splits": f"SELECT CAST(rep AS BIGINT) AS rep, side FROM (SELECT DISTINCT l_linenumber % 4 AS rep FROM lineitem), (VALUES {_column(_TREE_SIDES)}) t(side)",
    "supertree_refined": f"""WITH {_SIDES} SELECT CAST(tree_id AS BIGINT) AS rep, array_to_string(side, ',') AS side FROM canon
WHERE len(side) BETWEEN 2 AND 10 AND tree_id IN (SELECT l_linenumber % 4 FROM lineitem)""",
    "trees_read_back": f"""WITH {_SIDES} SELECT CAST(tree_id AS BIGINT) AS rep, array_to_string(side, ',') AS side FROM canon
WHERE len(side) BETWEEN 2 AND 10 AND tree_id IN (SELECT l_linenumber % 4 FROM lineitem)""",
    "replicates_run": f"""WITH {_PATTERNS},{_RANKS}, taken AS (SELECT * FROM ranks ORDER BY {_order('7', '0', 'rank')}, rank LIMIT 60),
sites AS (SELECT count(*) AS n FROM patterns JOIN taken USING (i0, i1, i2, i3))
SELECT rep, CAST(60 AS BIGINT) AS quartets, CAST(60 AS BIGINT) AS agree, CASE WHEN rep = 0 THEN CAST(n AS BIGINT) END AS nsnps FROM range(3) t(rep), sites""",
    "consensus_tree": f"WITH {_SIDES} SELECT side, round(freq, 6)::DOUBLE AS support FROM freqs WHERE freq >= 0.5 AND len(string_split(side, ',')) BETWEEN 2 AND 10",
    "rooted_tree": f"SELECT array_to_string(list_sort(string_split(clade, ',')), ',') AS clade FROM (VALUES {_column(_TREE_CLADES)}) t(clade)",
    "named_tree": f"""WITH clades AS (SELECT clade, unnest(string_split(clade, ',')) AS tip FROM (VALUES {_column(_TREE_CLADES)}) t(clade))
SELECT string_agg(n_name, ',' ORDER BY n_name) AS clade FROM clades JOIN nation ON n_nationkey = CAST(tip AS INTEGER) GROUP BY clades.clade""",
    "quartets_tsv": f"WITH {_QUARTETS} SELECT i0, i1, i2, i3, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, res, nsnps FROM quartets_fx WHERE rep = 1",
    "vcf_matrix": f"""WITH {_SNPS}, sites AS (SELECT DISTINCT locus, site FROM snps_fx), samples AS (SELECT CAST(i AS INTEGER) AS sample_idx FROM range(12) t(i))
SELECT sample_idx, locus, site, coalesce(base, 78) AS base FROM sites CROSS JOIN samples LEFT JOIN snps_fx USING (sample_idx, locus, site)""",
    "project_info": f"""WITH {_SNPS}, seen AS (SELECT count(DISTINCT sample_idx) AS n, count(DISTINCT site) AS k FROM snps_fx)
SELECT 'demo' AS name, 'embeddings' AS data, '.' AS workdir, '1' AS weights, 'False' AS subsample_snps, '100' AS nquartets, '7' AS random_seed, CAST(n AS VARCHAR) AS nsamples,
  CAST(k AS VARCHAR) AS nsnps, CAST(least(100, n * (n - 1) * (n - 2) * (n - 3) // 24) AS VARCHAR) AS nqrts, CAST(n * (n - 1) * (n - 2) * (n - 3) // 24 AS VARCHAR) AS nqrts_total FROM seen""",
    "resolve_ambiguity": f"WITH {_SNPS}, {_RESOLVED} SELECT * FROM resolved",
    "bootstrap_draws": f"WITH {_drawn(3)} SELECT * FROM drawn",
    "bootstrap_width": f"WITH {_drawn(3)} SELECT rep, CAST(sum(n_sites) AS BIGINT) AS width FROM drawn GROUP BY rep",
    "bootstrap_sites": f"""WITH {_drawn(1)},
sites AS (SELECT DISTINCT locus, site FROM snps_fx),
placed AS (
  SELECT rep, rlocus, locus, site, row_number() OVER (PARTITION BY rep ORDER BY rlocus, {_order('7', 'rep', 'rlocus', 'site')}, site) - 1 AS rsite
  FROM drawn JOIN sites USING (locus)),
cells AS (
  SELECT rep, rlocus, rsite, site, sample_idx, {_coin('base', '7', 'rep', 'sample_idx', 'site')} AS base FROM placed JOIN snps_fx USING (locus, site))
SELECT rep, rlocus, rsite, site, sample_idx, {_CODE} AS code FROM cells""",
    "population_pick": f"""WITH placed AS (
  SELECT rep, c_nationkey AS pop, c_custkey AS sample_idx, row_number() OVER (PARTITION BY rep, c_nationkey ORDER BY {_order('7', 'rep', 'c_nationkey', 'c_custkey')}, c_custkey) AS k FROM customer, range(5) r(rep))
SELECT rep, CAST(pop AS INTEGER) AS pop, CAST(sample_idx AS INTEGER) AS sample_idx FROM placed WHERE k = 1""",
    "population_map": "SELECT CAST(s_nationkey AS INTEGER) AS pop, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS samples FROM supplier GROUP BY 1",
    "population_subset": "SELECT n_nationkey AS sample_idx, n_name AS name FROM nation WHERE n_nationkey < 12 AND n_nationkey IN (SELECT c_nationkey FROM customer)",
    "pattern_counts_all": f"WITH {_PATTERNS} SELECT i0, i1, i2, i3, r, c, count(*) AS n FROM patterns GROUP BY ALL",
    "pattern_counts_unlinked": f"WITH {_UNLINKED} SELECT * FROM unlinked",
    "pattern_counts_random_snp": f"""WITH {_PATTERNS},
picked AS (SELECT *, row_number() OVER (PARTITION BY i0, i1, i2, i3, locus ORDER BY {_order('7', '0', 'i0', 'i1', 'i2', 'i3', 'site')}, site) AS k FROM patterns)
SELECT i0, i1, i2, i3, r, c, count(*) AS n FROM picked WHERE k = 1 GROUP BY ALL""",
    "flattenings": f"""WITH {_UNLINKED},
cells AS (SELECT i0, i1, i2, i3, n, r // 4 AS a, r % 4 AS b, c // 4 AS cc, c % 4 AS d FROM unlinked)
SELECT i0, i1, i2, i3, n, CAST(0 AS INTEGER) AS f, CAST(4 * a + b AS INTEGER) AS r, CAST(4 * cc + d AS INTEGER) AS c FROM cells
UNION ALL SELECT i0, i1, i2, i3, n, 1, CAST(4 * a + cc AS INTEGER), CAST(4 * b + d AS INTEGER) FROM cells
UNION ALL SELECT i0, i1, i2, i3, n, 2, CAST(4 * a + d AS INTEGER), CAST(4 * b + cc AS INTEGER) FROM cells""",
    "quartet_nsnps": f"WITH {_PATTERNS} SELECT i0, i1, i2, i3, count(*) AS nsnps FROM patterns GROUP BY ALL",
    "mean_nsnps": f"WITH {_QUARTETS} SELECT rep, avg(nsnps) AS mean_nsnps FROM quartets_fx GROUP BY rep",
    "no_data_quartets": f"""WITH {_ASKED}
SELECT i0, i1, i2, i3, 0.001::DOUBLE AS s0, 0.001::DOUBLE AS s1, 0.001::DOUBLE AS s2, CAST({_draw('7', '0', 'i0', 'i1', 'i2', 'i3')} % 3 AS INTEGER) AS res, CAST(0 AS BIGINT) AS nsnps FROM asked_q""",
    "best_resolutions": f"WITH {_QUARTETS} SELECT rep, i0, i1, i2, i3, res AS best FROM quartets_fx",
    "quartet_weights": f"""WITH {_QUARTETS} SELECT rep, i0, i1, i2, i3, 1.0::DOUBLE AS w0, round(upper, 6) AS w1, round(CASE WHEN lo = 0 THEN 1.0 ELSE upper / lo END, 6) AS w2,
round(1 - lo / (s0 + s1 + s2), 6) AS w3, round(CASE WHEN lo = 0 THEN 1.0 ELSE upper / lo END, 6) AS ratio FROM quartets_fx""",
    "qmc_lines": f"""WITH {_QUARTETS} SELECT rep, CASE res WHEN 0 THEN format('{{}},{{}}|{{}},{{}}', i0, i1, i2, i3) WHEN 1 THEN format('{{}},{{}}|{{}},{{}}', i0, i2, i1, i3)
ELSE format('{{}},{{}}|{{}},{{}}', i0, i3, i1, i2) END || ':' || printf('%.5f', upper) AS line FROM quartets_fx WHERE nsnps >= 5 AND CASE WHEN lo = 0 THEN 1.0 ELSE upper / lo END >= 1.5""",
    "min_filters": f"WITH {_QUARTETS} SELECT rep, i0, i1, i2, i3, res, nsnps FROM quartets_fx WHERE nsnps >= 20 AND CASE WHEN lo = 0 THEN 1.0 ELSE upper / lo END >= 3.0",
    "tree_quartets": f"WITH {_EDGES} SELECT * FROM tree_q",
    "edge_tallies": f"WITH {_mapped(25, 3.0)} {_tallies()}",
    "edge_tallies_by_rep": f"WITH {_mapped(25, 3.0)} {_tallies('rep, ')}",
    "edge_means": f"WITH {_mapped(0, 1.0)} SELECT edge_id, round(avg(nsnps), 4) AS nsnps, round(avg(upper), 4) AS weights, round(avg(score), 4) AS scores FROM mapped GROUP BY edge_id",
    "edge_stats": f"""WITH {_mapped(25, 3.0)}, tallies AS ({_tallies()}),
sized AS (SELECT *, conc + disc1 + disc2 AS nq, CAST(conc > 0 AS INTEGER) + CAST(disc1 > 0 AS INTEGER) + CAST(disc2 > 0 AS INTEGER) AS z FROM tallies)
SELECT edge_id, conc, disc1, disc2, nu, nqrts,
  round(CASE WHEN nq = 0 THEN NULL WHEN z = 1 THEN CASE WHEN conc > 0 THEN 1.0 ELSE -1.0 END ELSE 1 + (
    CASE WHEN conc > 0 THEN conc / nq * ln(conc / nq) ELSE 0 END + CASE WHEN disc1 > 0 THEN disc1 / nq * ln(disc1 / nq) ELSE 0 END
    + CASE WHEN disc2 > 0 THEN disc2 / nq * ln(disc2 / nq) ELSE 0 END) / ln(z) END, 6) AS qc,
  round(CASE WHEN disc1 + disc2 = 0 THEN 1.0 ELSE 1 - abs(disc1 - disc2) / (disc1 + disc2) END, 6) AS qd,
  round(1 - nu / (nq + nu), 6) AS qi FROM sized""",
    "tip_fidelity": f"""WITH {_mapped(25, 3.0)}, tips AS (SELECT unnest([i0, i1, i2, i3]) AS sample_idx, kind FROM mapped WHERE informative),
told AS (SELECT sample_idx, count(*) FILTER (kind = 0) AS qfc, count(*) FILTER (kind <> 0) AS qfd FROM tips GROUP BY 1)
SELECT sample_idx, qfc, qfd, round(qfc / (qfc + qfd), 6) AS qf FROM told""",
    "split_totals": f"WITH {_EDGES} SELECT CAST(edge_id AS INTEGER) AS edge_id, count(*) AS total FROM products GROUP BY edge_id",
    "split_sampled": f"""WITH {_QUARTETS}, {_EDGES}, chosen AS (SELECT DISTINCT i0, i1, i2, i3 FROM quartets_fx WHERE nsnps % 3 = 0)
SELECT CAST(e.edge_id AS INTEGER) AS edge_id, count(c.i0) AS sampled FROM edges e LEFT JOIN chosen c ON list_has_any(e.a, [c.i0, c.i1, c.i2, c.i3]) AND list_has_any(e.b, [c.i0, c.i1, c.i2, c.i3])
AND list_has_any(e.c, [c.i0, c.i1, c.i2, c.i3]) AND list_has_any(e.d, [c.i0, c.i1, c.i2, c.i3]) GROUP BY 1""",
    "quartet_scores_capped": f"""WITH {_RANKS},
lines AS (SELECT l_orderkey % 2 AS rep, l_orderkey % 495 AS qid, l_linenumber % 4 * 4 + day(l_shipdate) % 4 AS kind FROM lineitem),
cells AS (SELECT rep, qid, k, count(*) FILTER (kind = k) + k + 1 AS n FROM lines, range(16) t(k) GROUP BY rep, qid, k),
placed AS (SELECT rep, qid, n, row_number() OVER (PARTITION BY rep, qid ORDER BY n DESC) AS p FROM cells),
seen AS (SELECT rep, qid, CAST(coalesce(sum(n * n) FILTER (p > 10), 0) AS BIGINT) AS rest, CAST(sum(n) AS BIGINT) AS nsnps FROM placed GROUP BY rep, qid)
SELECT rep, i0, i1, i2, i3, rest AS s0_squared, rest AS s1_squared, rest AS s2_squared, nsnps FROM seen JOIN ranks ON qid = rank""",
    "quartets_equal_splits": f"""WITH {_RANKS}, samples AS (SELECT CAST(i AS INTEGER) AS tip FROM range(12) t(i)),
sides(edge_id, "right") AS (VALUES {", ".join(f"({i}, [{s}])" for i, s in enumerate(_ORDER))}),
halves AS (SELECT CAST(edge_id AS INTEGER) AS edge_id, "right" AS side, list_sort(list_filter(range(12), lambda x: NOT list_contains("right", x))) AS other FROM sides),
lefts AS (SELECT edge_id, j * (j - 1) // 2 + i AS p, side[i + 1] AS a, side[j + 1] AS b FROM halves, range(12) x(i), range(12) y(j) WHERE i < j AND j < len(side)),
rights AS (SELECT edge_id, j * (j - 1) // 2 + i AS p, other[i + 1] AS c, other[j + 1] AS d FROM halves, range(12) x(i), range(12) y(j) WHERE i < j AND j < len(other)),
sized AS (SELECT edge_id, len(side) * (len(side) - 1) // 2 AS nl, len(other) * (len(other) - 1) // 2 AS nr FROM halves),
tries AS (SELECT edge_id, nr, nl * nr AS total, unnest(range(CASE WHEN nl * nr < 46 THEN nl * nr ELSE 133 END)) AS t FROM sized),
named AS (SELECT edge_id, nr, total, t, CASE WHEN total < 46 THEN t ELSE ({_draw('7', 'edge_id', 't')} * 1048576 + {_draw('8', 'edge_id', 't')} % 1048576) % total END AS number FROM tries),
firsts AS (SELECT edge_id, nr, total, number, min(t) AS t FROM named GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY CASE WHEN total < 46 THEN {_order('7', 'edge_id', 'number')} ELSE lpad(CAST(t AS VARCHAR), 20, '0') END, number) AS k FROM firsts),
four AS (
  SELECT p.edge_id, list_sort([a, b, c, d]) AS q FROM placed p JOIN lefts l ON l.edge_id = p.edge_id AND l.p = p.number // p.nr JOIN rights r ON r.edge_id = p.edge_id AND r.p = p.number % p.nr WHERE k <= 23),
own AS (SELECT CAST(q[1] AS INTEGER) AS i0, CAST(q[2] AS INTEGER) AS i1, CAST(q[3] AS INTEGER) AS i2, CAST(q[4] AS INTEGER) AS i3, min(edge_id) AS edge_id FROM four GROUP BY q),
more AS (SELECT i0, i1, i2, i3 FROM ranks ORDER BY {_order('7', '0', 'rank')}, rank LIMIT 200),
every AS (SELECT i0, i1, i2, i3, edge_id, 0 AS late FROM own UNION ALL SELECT i0, i1, i2, i3, NULL, 1 FROM more ANTI JOIN own USING (i0, i1, i2, i3))
SELECT i0, i1, i2, i3, CAST(edge_id AS INTEGER) AS edge_id FROM every ORDER BY late, {_order('7', 'i0', 'i1', 'i2', 'i3')}, i0, i1, i2, i3 LIMIT 200""",
    "split_frequencies": f"WITH {_SIDES} SELECT side, n, freq::DOUBLE AS freq FROM freqs",
    "split_support": f"""WITH {_SIDES}, own(edge_id, side) AS (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(_ORDER))})
SELECT CAST(edge_id AS INTEGER) AS edge_id, coalesce(freq, 0.0)::DOUBLE AS support FROM own LEFT JOIN freqs USING (side)""",
    "relabel_tips": "SELECT n_nationkey AS sample_idx, n_name AS name FROM nation WHERE n_nationkey < 12",
}
