"""The whole specification grid in one plan: effects, percentile intervals and wild bootstrap tests of every cell.

A cell is an estimand (two sides) under a measurement.  Regions are summed once into blocks, with one sum for each
measurement; every cell is a signed sum over sides of those blocks.  One set of draws (how often a replicate draws a
block) and one set of signs serve all cells, so a block meets each replicate once, whatever the number of cells.

The test needs no table of blocks x families x replicates: flipped deviations keep their sum of squares, so a
replicate's t follows from the signed sum of the blocks that a family lies in, and from the sum of the signs.
"""

from __future__ import annotations

from ..plans.relations import CATALOGUE as C
from . import lexicon  # noqa: F401

#: Blocks from which a test, and replicates from which an interval, is given.
LEAST_BLOCKS = 30
VALUE = "CASE t.measure WHEN 'signed' THEN x.signed WHEN 'mass' THEN x.mass ELSE x.hits END"

C.relation("side_blocks", "SELECT block, side, {hex:concat_ws('|', 'block', block)} % 256 AS h, count(*) AS n FROM peaks WHERE searched = 1 GROUP BY block, side", stored=True)
C.relation("side_values", "SELECT block, side, family, sum(signed) AS signed, sum(mass) AS mass, sum(n_hits) AS hits FROM rf GROUP BY block, side, family", stored=True)
C.relation("side_sums", "SELECT side, family, sum(signed) AS signed, sum(mass) AS mass, sum(hits) AS hits FROM side_values GROUP BY side, family")
C.relation("side_sizes", "SELECT side, sum(n) AS n FROM side_blocks GROUP BY side")
# blocks are numbered inside 256 slots of their hash; a slot begins where those before it end
C.relation("grid_blocks", """
SELECT b.block, CAST(s.ahead + row_number() OVER (PARTITION BY b.h ORDER BY b.block) - 1 AS BIGINT) AS k, s.g FROM (SELECT block, h FROM side_blocks GROUP BY block, h) b
JOIN (SELECT h, sum(n) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS ahead, sum(n) OVER () AS g FROM (SELECT h, count(*) AS n FROM (SELECT block, h FROM side_blocks GROUP BY block, h) d GROUP BY h) c) s ON s.h = b.h""", stored=True)
# what a block holds, by its place: values of side and family; no family: regions of a side; no side: the sides that it has
C.relation("grid_held", """
SELECT /*+ MERGE(b) */ b.k, x.side, CAST(NULL AS ARRAY<STRING>) AS sides, x.family, x.signed, x.mass, x.hits FROM side_values x JOIN grid_blocks b ON b.block = x.block
UNION ALL SELECT /*+ MERGE(b) */ b.k, x.side, NULL AS sides, NULL AS family, NULL AS signed, NULL AS mass, x.n AS hits FROM side_blocks x JOIN grid_blocks b ON b.block = x.block
UNION ALL SELECT /*+ MERGE(b) */ b.k, NULL AS side, x.sides, NULL AS family, NULL AS signed, NULL AS mass, 1 AS hits FROM (SELECT block, array_sort(collect_set(side)) AS sides FROM side_blocks GROUP BY block) x JOIN grid_blocks b ON b.block = x.block""")
# draws and signs outnumber the blocks by the replicates: they are dealt by place and added up there, never sent whole
C.relation("weights", """
SELECT 'draw' AS kind, r, {hex:concat_ws('|', '{=seed}', CAST(r AS VARCHAR(20)), CAST(k AS VARCHAR(20)))} % g AS k, 1 AS w FROM (SELECT k, g, {explode:{=replicates}} AS r FROM (SELECT /*+ REPARTITION(64, k) */ k, g FROM grid_blocks) d) a
UNION ALL SELECT 'sign' AS kind, r, k, CASE WHEN {hex:concat_ws('|', 'sign', '{=seed}', CAST(r AS VARCHAR(20)), CAST(k AS VARCHAR(20)))} % 2 = 0 THEN 1 ELSE -1 END AS w FROM (SELECT k, {explode:{=replicates}} AS r FROM (SELECT /*+ REPARTITION(64, k) */ k FROM grid_blocks) d) c""")
C.relation("weighted", """
SELECT /*+ SHUFFLE_HASH(x) */ w.kind, w.r, x.side, x.sides, x.family, sum(w.w * x.signed) AS signed, sum(w.w * x.mass) AS mass, sum(w.w * x.hits) AS hits FROM weights w JOIN grid_held x ON x.k = w.k GROUP BY w.kind, w.r, x.side, x.sides, x.family""", stored=True)
C.relation("weighted_values", "SELECT kind, r, side, family, signed, mass, hits FROM weighted WHERE family IS NOT NULL")
C.relation("weighted_sizes", "SELECT r, side, hits AS n FROM weighted WHERE kind = 'draw' AND family IS NULL AND sides IS NULL")
# a cell's two sides with their signs; cells without regions on a side have no terms
C.relation("cell_terms", """
SELECT s.cell, s.measure, s.qs AS side, 1 AS sign FROM cell_sides s UNION ALL SELECT s.cell, s.measure, s.cs AS side, -1 AS sign FROM cell_sides s""")
C.relation("terms", """
SELECT t.cell, t.measure, t.side, t.sign, z.n FROM cell_terms t JOIN side_sizes z ON z.side = t.side AND z.n > 0
JOIN (SELECT c.cell FROM cell_terms c JOIN side_sizes y ON y.side = c.side AND y.n > 0 GROUP BY c.cell HAVING count(*) = 2) both ON both.cell = t.cell""", stored=True)
C.relation("cell_blocks", "SELECT t.cell, b.block FROM terms t JOIN side_blocks b ON b.side = t.side GROUP BY t.cell, b.block")
C.relation("cell_sizes", "SELECT cell, count(*) AS g FROM cell_blocks GROUP BY cell")
C.relation("grid_points", f"""
SELECT t.cell, x.family, sum(t.sign * ({VALUE}) / t.n) AS effect FROM terms t JOIN side_sums x ON x.side = t.side GROUP BY t.cell, x.family HAVING sum(x.hits) > 0""", stored=True)
C.relation("grid_reps", f"""
SELECT f.cell, f.family, f.r, coalesce(e.effect, 0) AS effect FROM
  (SELECT p.cell, p.family, v.r FROM grid_points p JOIN (SELECT t.cell, z.r FROM terms t JOIN weighted_sizes z ON z.side = t.side AND z.n > 0 GROUP BY t.cell, z.r HAVING count(*) = 2) v ON v.cell = p.cell) f
LEFT JOIN (SELECT t.cell, x.family, x.r, sum(t.sign * ({VALUE}) / z.n) AS effect FROM terms t JOIN weighted_values x ON x.side = t.side AND x.kind = 'draw' JOIN weighted_sizes z ON z.side = t.side AND z.r = x.r AND z.n > 0 GROUP BY t.cell, x.family, x.r) e
  ON e.cell = f.cell AND e.family = f.family AND e.r = f.r""")
C.relation("grid_ci", """
SELECT cell, family, max(CASE WHEN i = greatest(0, CAST(floor(0.025 * n) AS BIGINT) - 1) THEN effect END) AS ci_low, max(CASE WHEN i = least(n - 1, CAST(ceil(0.975 * n) AS BIGINT) - 1) THEN effect END) AS ci_high, max(n) AS n_replicates FROM
  (SELECT cell, family, effect, row_number() OVER (PARTITION BY cell, family ORDER BY effect, r) - 1 AS i, count(*) OVER (PARTITION BY cell, family) AS n FROM (SELECT cell, family, r, round(effect, 9) AS effect FROM grid_reps) a) b GROUP BY cell, family""")
C.relation("grid_moments", f"""
SELECT e.cell, e.family, max(e.g) AS g, sum(e.e) / max(e.g) AS m, sum(e.e * e.e) AS squares FROM
  (SELECT t.cell, x.family, x.block, max(z.g) AS g, sum(z.g * t.sign * ({VALUE}) / t.n) AS e FROM terms t JOIN side_values x ON x.side = t.side JOIN cell_sizes z ON z.cell = t.cell GROUP BY t.cell, x.family, x.block) e GROUP BY e.cell, e.family""")
# squares about the mean; what rounding leaves of nothing is nothing
C.relation("grid_spread", "SELECT cell, family, g, m, squares - g * m * m AS ss, CASE WHEN g > 1 AND squares - g * m * m > 1e-12 * squares THEN m / sqrt((squares - g * m * m) / (g - 1) / g) END AS t FROM grid_moments", stored=True)
C.relation("grid_signed", f"""
SELECT t.cell, x.family, x.r, sum(t.sign * ({VALUE}) / t.n) AS s FROM terms t JOIN weighted_values x ON x.side = t.side AND x.kind = 'sign' GROUP BY t.cell, x.family, x.r""")
C.relation("grid_wild", """
SELECT a.cell, a.family, a.r, m.t, CASE WHEN m.t IS NOT NULL AND m.ss - m.g * a.mean * a.mean > 1e-12 * m.ss THEN a.mean / sqrt((m.ss - m.g * a.mean * a.mean) / (m.g - 1) / m.g) END AS tr FROM
  (SELECT s.cell, s.family, s.r, s.s - p.m * b.signs / p.g AS mean FROM grid_signed s JOIN grid_spread p ON p.cell = s.cell AND p.family = s.family
   JOIN (SELECT cell, r, sum(hits) AS signs FROM (SELECT DISTINCT t.cell, w.r, w.sides, w.hits FROM terms t JOIN weighted w ON w.kind = 'sign' AND array_contains(w.sides, t.side)) c GROUP BY cell, r) b ON b.cell = s.cell AND b.r = s.r) a
JOIN grid_spread m ON m.cell = a.cell AND m.family = a.family""")
C.relation("grid_p", f"""
SELECT cell, family, CASE WHEN max(t) IS NOT NULL AND count(tr) >= {LEAST_BLOCKS} THEN (sum(CASE WHEN abs(round(tr, 9)) >= abs(round(t, 9)) THEN 1 ELSE 0 END) + 1e0) / (count(tr) + 1) END AS p_value FROM grid_wild GROUP BY cell, family""")
C.query("grid_intervals", f"""
SELECT cell, family, round(effect, 9) AS effect, ci_low, ci_high, n_replicates, n_blocks, round(p_value, 9) AS p_value,
       round(CASE WHEN p_value IS NOT NULL THEN least(1e0, min(p_value * m / i) OVER (PARTITION BY cell ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END, 9) AS q_value,
       CASE WHEN n_replicates < {{=least_replicates}} THEN 'REFUSED' WHEN p_value IS NULL THEN 'ESTIMATION_ONLY' ELSE 'INTERVAL_AND_TEST' END AS status
FROM (SELECT y.*, row_number() OVER (PARTITION BY cell ORDER BY round(p_value, 12) NULLS LAST, family) AS i, count(p_value) OVER (PARTITION BY cell) AS m FROM
  (SELECT p.cell, p.family, p.effect, c.ci_low, c.ci_high, c.n_replicates, z.g AS n_blocks, CASE WHEN z.g >= {LEAST_BLOCKS} THEN w.p_value END AS p_value
   FROM grid_points p JOIN cell_sizes z ON z.cell = p.cell JOIN grid_ci c ON c.cell = p.cell AND c.family = p.family LEFT JOIN grid_p w ON w.cell = p.cell AND w.family = p.family) y) x""")

# The same numbers by dense tables: every block of a cell for every family, flipped one by one.
C.check("grid_intervals", """
WITH hit AS (
  SELECT o_orderkey AS region, o_orderstatus AS side, o_orderpriority || ':' || CAST(floor(o_orderkey * 100 / 20000) AS BIGINT) AS block, p_type AS family,
         l_discount >= 0.02 AS used, CASE WHEN l_discount >= 0.02 THEN (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice * (1 - l_discount) / 1000 END AS v, l_orderkey IS NOT NULL OR o_orderstatus <> 'P' AS searched
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
size AS (SELECT side, block, count(DISTINCT region) AS n FROM hit WHERE searched GROUP BY ALL),
val AS (SELECT side, block, family, sum(v) AS signed, sum(abs(v)) AS mass, count(*) FILTER (used) AS hits FROM hit WHERE family IS NOT NULL GROUP BY ALL),
long AS (SELECT side, block, family, m, coalesce(CASE m WHEN 'signed' THEN signed WHEN 'mass' THEN mass ELSE hits END, 0) AS v, hits FROM val, (VALUES ('signed'), ('mass'), ('count')) AS k(m)),
pair AS (SELECT * FROM (VALUES ('F_vs_O', 'F', 'O'), ('O_vs_F', 'O', 'F'), ('F_vs_P', 'F', 'P')) AS e(estimand, q, c) WHERE q IN (SELECT side FROM size) AND c IN (SELECT side FROM size)),
num AS (SELECT block, row_number() OVER (ORDER BY CAST(('0x' || substr(md5('block|' || block), 1, 8)) AS BIGINT) % 256, block) - 1 AS k, count(*) OVER () AS g FROM (SELECT DISTINCT block FROM size) d),
fam AS (SELECT estimand, family FROM pair JOIN val ON side IN (q, c) GROUP BY ALL HAVING sum(hits) > 0),
blk AS (SELECT estimand, block, coalesce(sum(n) FILTER (side = q), 0) AS nq, coalesce(sum(n) FILTER (side = c), 0) AS nc FROM pair JOIN size ON side IN (q, c) GROUP BY ALL),
dense AS (
  SELECT estimand, m, block, family, nq, nc, coalesce(sum(v) FILTER (side = q), 0) AS vq, coalesce(sum(v) FILTER (side = c), 0) AS vc
  FROM pair JOIN blk USING (estimand) JOIN fam USING (estimand) CROSS JOIN (VALUES ('signed'), ('mass'), ('count')) AS k(m) LEFT JOIN long USING (block, family, m) GROUP BY ALL),
tot AS (SELECT estimand, sum(nq) AS tq, sum(nc) AS tc, count(*) AS g FROM blk GROUP BY estimand),
rep AS (SELECT unnest(range(0, 200)) AS r),
draw AS (SELECT r, b.block, count(*) AS w FROM (SELECT r, CAST(('0x' || substr(md5('7|' || r || '|' || k), 1, 8)) AS BIGINT) % g AS pick FROM num, rep) s JOIN num b ON b.k = pick GROUP BY ALL),
boot AS (SELECT estimand, m, family, r, sum(w * vq) / nullif(sum(w * nq), 0) - sum(w * vc) / nullif(sum(w * nc), 0) AS effect FROM dense JOIN draw USING (block) GROUP BY ALL),
ends AS (SELECT estimand, m, family, len(l) AS n, l[greatest(0, CAST(floor(0.025 * len(l)) AS BIGINT) - 1) + 1] AS ci_low, l[least(len(l) - 1, CAST(ceil(0.975 * len(l)) AS BIGINT) - 1) + 1] AS ci_high
  FROM (SELECT estimand, m, family, list_sort(list(round(effect, 9))) AS l FROM boot WHERE effect IS NOT NULL GROUP BY ALL) x),
eff AS (SELECT estimand, m, family, block, g, g * vq / tq - g * vc / tc AS e FROM dense JOIN tot USING (estimand)),
one AS (SELECT estimand, m, family, max(g) AS g, avg(e) AS effect, CASE WHEN stddev_samp(e) > 1e-9 THEN avg(e) / (stddev_samp(e) / sqrt(count(*))) END AS t FROM eff GROUP BY ALL),
wild AS (
  SELECT estimand, m, family, r, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS tr FROM
    (SELECT a.estimand, a.m, a.family, r, (CASE WHEN CAST(('0x' || substr(md5('sign|7|' || r || '|' || k), 1, 8)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) * (e - effect) AS x FROM eff a JOIN one b USING (estimand, m, family) JOIN num USING (block), rep) y
  GROUP BY ALL),
p AS (SELECT o.estimand, o.m, o.family, o.g, o.effect, CASE WHEN o.g >= 30 AND max(o.t) IS NOT NULL THEN (count(*) FILTER (abs(round(tr, 9)) >= abs(round(o.t, 9))) + 1) / 201 END AS p FROM one o JOIN wild w USING (estimand, m, family) GROUP BY o.estimand, o.m, o.family, o.g, o.effect),
ranked AS (SELECT *, row_number() OVER (PARTITION BY estimand, m ORDER BY round(p, 12) NULLS LAST, family) AS i, count(p) OVER (PARTITION BY estimand, m) AS total FROM p)
SELECT r.estimand || '/' || r.m AS cell, r.family, round(r.effect, 9) AS effect, ci_low, ci_high, n AS n_replicates, g AS n_blocks, round(p, 9) AS p_value,
       round(CASE WHEN p IS NOT NULL THEN least(1, min(p * total / i) OVER (PARTITION BY r.estimand, r.m ORDER BY i DESC)) END, 9) AS q_value, CASE WHEN p IS NULL THEN 'ESTIMATION_ONLY' ELSE 'INTERVAL_AND_TEST' END AS status
FROM ranked r JOIN ends USING (estimand, m, family)""")
