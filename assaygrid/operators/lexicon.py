"""Lexicons: tiers, loading order, comparisons, counters and triggers; permissions of a reading; guards; the specification grid."""

from __future__ import annotations

from ..plans.relations import CATALOGUE as C

C.relation("nodes", """
SELECT p_partkey AS node_id, CASE WHEN p_size % 2 = 0 THEN 'pos' ELSE 'neg' END AS metacluster, p_type AS family, p_brand AS variant, p_size AS size,
       CASE {hex:concat_ws('|', 'tier', p_brand)} % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'expanded' ELSE 'excluded' END AS tier, p_retailprice AS seqlets FROM part""")
C.relation("tiers", "SELECT 'core' AS lexicon, n.* FROM nodes n WHERE tier = 'core' UNION ALL SELECT 'expanded' AS lexicon, n.* FROM nodes n WHERE tier IN ('core', 'expanded')")
C.query("tier_members", "SELECT lexicon, node_id, family, metacluster FROM tiers")
# places are counted within slots of 1,000 ids, and a slot begins where those before it end
C.relation("tier_slots", """
SELECT lexicon, metacluster, slot, sum(n) OVER (PARTITION BY lexicon, metacluster ORDER BY slot) - n AS ahead FROM
  (SELECT lexicon, metacluster, CAST(floor(node_id / 1000) AS BIGINT) AS slot, count(*) AS n FROM tiers GROUP BY lexicon, metacluster, CAST(floor(node_id / 1000) AS BIGINT)) x""")
C.query("loader_order", """
SELECT t.lexicon, t.node_id, t.metacluster, concat('pattern_', CAST(ahead + i - 1 AS VARCHAR(20))) AS pattern, CAST(ahead + i AS BIGINT) AS place FROM
  (SELECT lexicon, node_id, metacluster, CAST(floor(node_id / 1000) AS BIGINT) AS slot, row_number() OVER (PARTITION BY lexicon, metacluster, CAST(floor(node_id / 1000) AS BIGINT) ORDER BY node_id) AS i FROM tiers) t
JOIN tier_slots s ON s.lexicon = t.lexicon AND s.metacluster = t.metacluster AND s.slot = t.slot""")
C.check("loader_order", """
SELECT lexicon, p_partkey AS node_id, metacluster, 'pattern_' || (place - 1) AS pattern, place FROM
  (SELECT l.lexicon, p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pos' ELSE 'neg' END AS metacluster, row_number() OVER (PARTITION BY l.lexicon, p_size % 2 ORDER BY p_partkey) AS place
   FROM part, (VALUES ('core', 0), ('expanded', 1)) AS l(lexicon, upto) WHERE CAST(('0x' || substr(md5('tier|' || p_brand), 1, 8)) AS BIGINT) % 3 <= l.upto) x""")
C.query("tier_comparison", "SELECT family, sum(CASE WHEN lexicon = 'core' THEN 1 ELSE 0 END) AS n_core, sum(CASE WHEN lexicon = 'expanded' THEN 1 ELSE 0 END) AS n_expanded, sum(CASE WHEN lexicon = 'expanded' AND tier <> 'core' THEN 1 ELSE 0 END) AS n_added FROM tiers GROUP BY family")
C.query("variant_counter", "SELECT family, count(DISTINCT variant) AS n_variants, count(*) AS n_nodes FROM nodes GROUP BY family")
C.query("sensitivity_triggers", """
SELECT node_id, concat_ws(',', CASE WHEN size <= 6 THEN 'confidence' END, CASE WHEN metacluster = 'neg' THEN 'family_ambiguity' END, CASE WHEN seqlets < 1000 THEN 'threshold_sensitive' END) AS triggers FROM nodes""")
C.query("mean_combination_check", """
SELECT n.family, round(sum(n.seqlets * n.size) / nullif(sum(n.size), 0), 6) AS weighted_mean, round(avg(n.seqlets), 6) AS plain_mean, min(n.node_id) AS representative FROM nodes n WHERE tier <> 'excluded' GROUP BY n.family""")
# How a set of regions may have been selected, and what may be said of it.
C.relation("provenance", """
SELECT * FROM (VALUES ('EXTERNAL', 'FULL_INFERENCE', 'EXTERNAL_STRUCTURE', 'SUBSTRATE_CIRCULAR'), ('PROGRAMMATIC_RULE', 'FULL_INFERENCE', 'INTERNAL_DECOMPOSITION', 'SUBSTRATE_CIRCULAR'),
  ('CLUSTERED_WITH_SPLIT', 'HELD_OUT_INFERENCE', 'INTERNAL_DECOMPOSITION', 'SUBSTRATE_CIRCULAR'), ('CLUSTERED_NO_SPLIT', 'DESCRIPTIVE_ONLY', 'INTERNAL_DECOMPOSITION', 'SUBSTRATE_CIRCULAR'),
  ('EYEBALLED', 'DESCRIPTIVE_ONLY', 'INTERNAL_DECOMPOSITION', 'SUBSTRATE_CIRCULAR'), ('MODEL_SELECTED_NO_TRANSCRIPT', 'DESCRIPTIVE_ONLY', 'CONDITIONING_UNVERIFIABLE', 'CONDITIONING_UNVERIFIABLE'),
  ('DECLARATION_MISSING', 'DESCRIPTIVE_ONLY', 'CONDITIONING_UNVERIFIABLE', 'CONDITIONING_UNVERIFIABLE')) AS v(how, license, scope_plain, scope_attribution)""")
C.query("permission_matrix", """
SELECT how, license, scope_plain AS scope, false AS attribution_derived, license <> 'DESCRIPTIVE_ONLY' AS may_test FROM provenance
UNION ALL SELECT how, license, scope_attribution AS scope, true AS attribution_derived, license <> 'DESCRIPTIVE_ONLY' AS may_test FROM provenance""")
C.relation("specs", """
SELECT estimand, measure, concat_ws('/', estimand, measure) AS cell FROM (VALUES ('F_vs_O', 'signed'), ('F_vs_O', 'mass'), ('F_vs_O', 'count'), ('O_vs_F', 'signed'), ('O_vs_F', 'mass'), ('O_vs_F', 'count'),
  ('F_vs_P', 'signed'), ('F_vs_P', 'mass'), ('F_vs_P', 'count')) AS v(estimand, measure)""")
C.relation("cell_sides", """
SELECT cell, estimand, measure, substr(estimand, 1, 1) AS qs, substr(estimand, 6, 1) AS cs FROM specs""")
C.relation("side_family", "SELECT side, family, sum(signed) AS signed, sum(mass) AS mass, sum(n_hits) AS n FROM rf GROUP BY side, family")
C.relation("side_n", "SELECT side, sum(searched) AS n FROM peaks GROUP BY side")
C.relation("cell_status", """
SELECT s.*, nq.n AS nq, nc.n AS nc, CASE WHEN nq.n > 0 AND nc.n > 0 THEN 'SUCCESS' ELSE 'REFUSED_SCHEMA' END AS status
FROM cell_sides s LEFT JOIN side_n nq ON nq.side = s.qs LEFT JOIN side_n nc ON nc.side = s.cs""")
C.relation("families", """
SELECT family, max(listed) AS listed FROM (SELECT family, 1 AS listed FROM side_family UNION ALL SELECT p_type AS family, 0 AS listed FROM part WHERE p_type IS NOT NULL) u GROUP BY family""")
# every family for every cell: the families, which the lexicon bounds, are one array
C.relation("framed_cells", "SELECT c.*, {each:fams} AS family FROM (SELECT s.*, (SELECT {list:family} FROM families) AS fams FROM cell_status s) c")
C.relation("whole_grid", """
SELECT s.cell, s.estimand, s.status, s.family, f.listed, CASE WHEN q.family IS NULL AND c.family IS NULL THEN 0 ELSE 1 END AS searched,
       CASE WHEN s.status = 'SUCCESS' AND coalesce(q.n, 0) + coalesce(c.n, 0) > 0 THEN
         coalesce(CASE s.measure WHEN 'signed' THEN q.signed WHEN 'mass' THEN q.mass ELSE q.n END, 0) / s.nq - coalesce(CASE s.measure WHEN 'signed' THEN c.signed WHEN 'mass' THEN c.mass ELSE c.n END, 0) / s.nc END AS effect
FROM framed_cells s JOIN families f ON f.family = s.family LEFT JOIN side_family q ON q.side = s.qs AND q.family = s.family LEFT JOIN side_family c ON c.side = s.cs AND c.family = s.family""")
C.query("spec_grid", "SELECT cell, estimand, measure FROM specs")
C.query("grid_effects", "SELECT cell, family, round(effect, 9) AS effect FROM whole_grid")
C.query("family_cell_states", """
SELECT cell, family, CASE WHEN status <> 'SUCCESS' THEN 'CELL_REFUSED' WHEN listed = 0 THEN 'NOT_IN_LEXICON' WHEN searched = 0 THEN 'NOT_SEARCHED'
  WHEN effect IS NULL THEN 'NOT_ESTIMABLE' WHEN round(effect, 12) = 0 THEN 'MEASURED_ZERO' ELSE 'ESTIMATED' END AS state FROM whole_grid""")
C.query("stability_within_estimand", """
SELECT estimand, family, count(*) AS n_cells, sum(CASE WHEN effect > 0 THEN 1 ELSE 0 END) AS n_positive, sum(CASE WHEN effect < 0 THEN 1 ELSE 0 END) AS n_negative, round(min(effect), 9) AS least, round(median(effect), 9) AS middle, round(max(effect), 9) AS most FROM whole_grid WHERE effect IS NOT NULL GROUP BY estimand, family""")
C.query("cell_status_histogram", """
SELECT v.status, coalesce(n, 0) AS n_cells FROM (VALUES ('SUCCESS'), ('REFUSED_GUARD'), ('REFUSED_SCHEMA'), ('NOT_ESTIMABLE'), ('ERROR')) AS v(status)
LEFT JOIN (SELECT status, count(*) AS n FROM cell_status GROUP BY status) g ON g.status = v.status""")
# The checking texts are written apart: from the tables, over the union of the families of both sides.
_GRID = """
WITH hit AS (
  SELECT o_orderkey AS region, o_orderstatus AS side, p_type AS family, l_discount >= 0.02 AS used, l_orderkey IS NOT NULL OR o_orderstatus <> 'P' AS searched,
         CASE WHEN l_discount >= 0.02 THEN (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice * (1 - l_discount) / 1000 END AS v
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
size AS (SELECT side, count(DISTINCT region) FILTER (searched) AS n FROM hit GROUP BY side),
val AS (SELECT side, family, m, coalesce(CASE m WHEN 'signed' THEN sum(v) WHEN 'mass' THEN sum(abs(v)) ELSE count(*) FILTER (used) END, 0) AS v, count(*) FILTER (used) AS n
        FROM hit CROSS JOIN (VALUES ('signed'), ('mass'), ('count')) AS k(m) WHERE family IS NOT NULL GROUP BY side, family, m),
cell AS (SELECT estimand, m, q, c, coalesce((SELECT n FROM size WHERE side = q), 0) AS nq, coalesce((SELECT n FROM size WHERE side = c), 0) AS nc
         FROM (VALUES ('F_vs_O', 'F', 'O'), ('O_vs_F', 'O', 'F'), ('F_vs_P', 'F', 'P')) AS e(estimand, q, c) CROSS JOIN (VALUES ('signed'), ('mass'), ('count')) AS k(m)),
fam AS (SELECT p_type AS family FROM part WHERE p_type IS NOT NULL UNION SELECT family FROM val),
grid AS (
  SELECT cell.estimand || '/' || cell.m AS cell, estimand, nq > 0 AND nc > 0 AS good, fam.family, fam.family IN (SELECT family FROM val) AS listed, a.v IS NOT NULL OR b.v IS NOT NULL AS searched,
         CASE WHEN nq > 0 AND nc > 0 AND coalesce(a.n, 0) + coalesce(b.n, 0) > 0 THEN coalesce(a.v, 0) / nq - coalesce(b.v, 0) / nc END AS effect
  FROM cell CROSS JOIN fam LEFT JOIN val a ON a.side = q AND a.family = fam.family AND a.m = cell.m LEFT JOIN val b ON b.side = c AND b.family = fam.family AND b.m = cell.m)
"""
C.check("grid_effects", _GRID + "SELECT cell, family, round(effect, 9) AS effect FROM grid")
C.check("family_cell_states", _GRID + """
SELECT cell, family, CASE WHEN NOT good THEN 'CELL_REFUSED' WHEN NOT listed THEN 'NOT_IN_LEXICON' WHEN NOT searched THEN 'NOT_SEARCHED' WHEN effect IS NULL THEN 'NOT_ESTIMABLE' WHEN round(effect, 12) = 0 THEN 'MEASURED_ZERO' ELSE 'ESTIMATED' END AS state FROM grid""")
C.check("stability_within_estimand", _GRID + """
SELECT estimand, family, count(*) AS n_cells, count(*) FILTER (effect > 0) AS n_positive, count(*) FILTER (effect < 0) AS n_negative, round(min(effect), 9) AS least, round(quantile_cont(effect, 0.5), 9) AS middle, round(max(effect), 9) AS most
FROM grid WHERE effect IS NOT NULL GROUP BY estimand, family""")
C.check("cell_status_histogram", _GRID + """
SELECT status, count(cell) AS n_cells FROM (VALUES ('SUCCESS'), ('REFUSED_GUARD'), ('REFUSED_SCHEMA'), ('NOT_ESTIMABLE'), ('ERROR')) AS v(status)
LEFT JOIN (SELECT DISTINCT cell, CASE WHEN good THEN 'SUCCESS' ELSE 'REFUSED_SCHEMA' END AS status FROM grid) g USING (status) GROUP BY status""")
C.query("guard_battery", """
SELECT 'four_states' AS guard, count(*) = 0 AS passed FROM hits WHERE state NOT IN ('not_searched', 'no_sequence_match', 'hit_below_floor', 'used')
UNION ALL SELECT 'coordinates' AS guard, count(*) = 0 AS passed FROM hits WHERE start_bp >= end_bp
UNION ALL SELECT 'absence_is_not_zero' AS guard, count(*) = 0 AS passed FROM hits WHERE state <> 'used' AND coefficient IS NOT NULL
UNION ALL SELECT 'disjoint_sides' AS guard, count(*) = 0 AS passed FROM (SELECT region_id FROM regions GROUP BY region_id HAVING count(DISTINCT side) > 1) d
UNION ALL SELECT 'block_floor' AS guard, min(n_blocks) >= 30 AS passed FROM health
UNION ALL SELECT 'unique_cells' AS guard, count(*) = count(DISTINCT cell) AS passed FROM specs""")
