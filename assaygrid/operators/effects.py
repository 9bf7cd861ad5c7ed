"""Effects of a query side against a comparator side, with block-level resampling.

The mean of a resample of whole blocks depends only on sums and counts of blocks, so replicates join a few
numbers of each block with its draws; regions are never read again.  Draws come from hashes of
(seed, replicate, slot), alike in any partitioning.

Draws outnumber blocks by the replicates, and compressed files tell little of that, so no table of draws is sent
whole: Spark deals draws by block and adds them up where the block's numbers lie.
"""

from __future__ import annotations

from ..plans.relations import CATALOGUE as C

C.relation("sums", """
SELECT block, {hex:concat_ws('|', 'block', block)} % 256 AS h, sum(CASE WHEN side = 'F' THEN 1 ELSE 0 END) AS nq, sum(CASE WHEN side = 'O' THEN 1 ELSE 0 END) AS nc
FROM peaks WHERE searched = 1 AND side IN ('F', 'O') GROUP BY block""", stored=True)
# blocks are numbered inside 256 slots of their hash; a slot begins where those before it end
C.relation("slots", "SELECT h, sum(n) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS ahead FROM (SELECT h, count(*) AS n FROM sums GROUP BY h) s")
C.relation("blk", """
SELECT block, CAST(ahead + row_number() OVER (PARTITION BY b.h ORDER BY block) - 1 AS BIGINT) AS k, nq, nc,
       (SELECT sum(nq) FROM sums) AS gq, (SELECT sum(nc) FROM sums) AS gc, (SELECT count(*) FROM sums) AS g FROM sums b JOIN slots s ON s.h = b.h""", stored=True)
C.relation("fb", """
SELECT family, block, sum(CASE WHEN side = 'F' THEN signed ELSE 0 END) AS q, sum(CASE WHEN side = 'O' THEN signed ELSE 0 END) AS c, sum(n_hits) AS n_hits
FROM rf WHERE side IN ('F', 'O') GROUP BY family, block""", stored=True)
C.relation("fam", "SELECT family, sum(q) AS q, sum(c) AS c FROM fb GROUP BY family HAVING sum(n_hits) > 0")
C.relation("point", """
SELECT family, q / nq - c / nc AS effect, q / nq AS mean_q, c / nc AS mean_c FROM (SELECT f.*, (SELECT max(gq) FROM blk) AS nq, (SELECT max(gc) FROM blk) AS nc FROM fam f) x WHERE nq > 0 AND nc > 0""")
# every block for every family: the families, which the lexicon bounds, are one array
C.relation("framed", "SELECT block, k, nq, nc, gq, gc, g, {each:fams} AS family FROM (SELECT b.*, (SELECT {list:family} FROM fam) AS fams FROM blk b) x")
C.relation("dense", """
SELECT d.*, g * q / gq - g * c / gc AS e FROM
  (SELECT b.*, coalesce(x.q, 0) AS q, coalesce(x.c, 0) AS c FROM framed b LEFT JOIN fb x ON x.family = b.family AND x.block = b.block) d WHERE gq > 0 AND gc > 0""", stored=True)
C.relation("draws", """
SELECT s.r, b.block, b.nq, b.nc, count(*) AS w FROM
  (SELECT r, {hex:concat_ws('|', '{=seed}', CAST(r AS VARCHAR(20)), CAST(k AS VARCHAR(20)))} % g AS pick FROM (SELECT k, g, {explode:{=replicates}} AS r FROM blk) a) s
JOIN blk b ON b.k = s.pick GROUP BY s.r, b.block, b.nq, b.nc""")
C.relation("reps", """
SELECT n.family, n.r, n.q / s.nq - n.c / s.nc AS effect FROM
  (SELECT fb.family, d.r, sum(d.w * fb.q) AS q, sum(d.w * fb.c) AS c FROM draws d JOIN fb ON fb.block = d.block JOIN fam ON fam.family = fb.family GROUP BY fb.family, d.r) n
JOIN (SELECT r, sum(w * nq) AS nq, sum(w * nc) AS nc FROM draws GROUP BY r) s ON s.r = n.r AND s.nq > 0 AND s.nc > 0""", stored=True)
# for Spark: numbers of a block by its place, those of no family are its regions; each draw meets them once, by key
C.spark("block_values", """
SELECT k, CAST(NULL AS STRING) AS family, CAST(nq AS DOUBLE) AS q, CAST(nc AS DOUBLE) AS c FROM blk
UNION ALL SELECT /*+ MERGE(b) */ b.k, f.family, f.q, f.c FROM fb f JOIN blk b ON b.block = f.block""")
C.spark("drawn_sums", """
SELECT /*+ SHUFFLE_HASH(v) */ v.family, s.r, sum(v.q) AS q, sum(v.c) AS c FROM
  (SELECT r, {hex:concat_ws('|', '{=seed}', CAST(r AS VARCHAR(20)), CAST(k AS VARCHAR(20)))} % g AS pick FROM (SELECT k, g, {explode:{=replicates}} AS r FROM (SELECT /*+ REPARTITION(64, k) */ k, g FROM blk) d) a) s
JOIN block_values v ON v.k = s.pick GROUP BY v.family, s.r""", stored=True)
C.spark("reps", """
SELECT n.family, n.r, n.q / s.nq - n.c / s.nc AS effect FROM drawn_sums n JOIN fam ON fam.family = n.family
JOIN (SELECT r, q AS nq, c AS nc FROM drawn_sums WHERE family IS NULL) s ON s.r = n.r AND s.nq > 0 AND s.nc > 0""", stored=True)
C.relation("percentile_ci", """
SELECT family, max(CASE WHEN i = lo THEN effect END) AS ci_low, max(CASE WHEN i = hi THEN effect END) AS ci_high, max(n) AS n_replicates FROM
  (SELECT family, effect, i, n, greatest(0, CAST(floor(0.025 * n) AS BIGINT) - 1) AS lo, least(n - 1, CAST(ceil(0.975 * n) AS BIGINT) - 1) AS hi FROM
    (SELECT family, round(effect, 9) AS effect, row_number() OVER (PARTITION BY family ORDER BY round(effect, 9), r) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM reps) a) b
GROUP BY family""")
C.relation("jack", """
SELECT d.family, d.block, (f.q - d.q) / (gq - nq) - (f.c - d.c) / (gc - nc) AS theta FROM dense d JOIN fam f ON f.family = d.family WHERE gq > nq AND gc > nc""")
C.relation("wild", """
SELECT family, r, CASE WHEN min(we) = max(we) THEN NULL ELSE avg(we) / (stddev_samp(we) / sqrt(count(*))) END AS t FROM
  (SELECT family, r, (CASE WHEN {hex:concat_ws('|', 'sign', '{=seed}', CAST(r AS VARCHAR(20)), CAST(k AS VARCHAR(20)))} % 2 = 0 THEN 1 ELSE -1 END) * (e - m) AS we FROM
    (SELECT d.family, d.k, d.e, s.m, {explode:{=replicates}} AS r FROM dense d JOIN (SELECT family, avg(e) AS m FROM dense GROUP BY family) s ON s.family = d.family) a) b
GROUP BY family, r""")
C.relation("wild_p", """
SELECT o.family, o.t, (sum(CASE WHEN abs(round(w.t, 9)) >= abs(round(o.t, 9)) THEN 1 ELSE 0 END) + 1e0) / ({=replicates} + 1) AS p_value, count(w.t) AS n_valid
FROM (SELECT family, CASE WHEN min(e) = max(e) THEN NULL ELSE avg(e) / (stddev_samp(e) / sqrt(count(*))) END AS t FROM dense GROUP BY family) o JOIN wild w ON w.family = o.family GROUP BY o.family, o.t""")

C.query("family_effect_point", "SELECT family, round(effect, 9) AS effect, round(mean_q, 9) AS mean_query, round(mean_c, 9) AS mean_comparator FROM point")
C.query("block_effects", "SELECT family, block, round(e, 6) AS block_effect FROM dense")
C.query("effect_bootstrap_replicates", "SELECT family, CAST(r AS BIGINT) AS replicate, round(effect, 9) AS effect FROM reps")
C.query("effect_ci_percentile", "SELECT p.family, round(p.effect, 9) AS effect, ci_low, ci_high, n_replicates, CASE WHEN n_replicates >= {=least_replicates} THEN 'ESTIMATED' ELSE 'REFUSED' END AS status FROM point p JOIN percentile_ci c ON c.family = p.family")
C.query("block_jackknife", "SELECT family, block, round(theta, 9) AS theta FROM jack")
C.relation("acceleration", """
SELECT family, round(CASE WHEN sum(d * d) > 0 THEN sum(d * d * d) / (6 * power(sum(d * d), 1.5)) ELSE 0 END, 9) AS acceleration, count(*) AS n_blocks
FROM (SELECT j.family, m.t - j.theta AS d FROM jack j JOIN (SELECT family, avg(theta) AS t FROM jack GROUP BY family) m ON m.family = j.family) x GROUP BY family""")
C.query("bca_acceleration", "SELECT family, acceleration, n_blocks FROM acceleration")
C.relation("bias", """
SELECT r.family, round(greatest(1 / (2e0 * count(*)), least(1 - 1 / (2e0 * count(*)), (sum(CASE WHEN round(r.effect, 9) < round(p.effect, 9) THEN 1e0 ELSE 0e0 END) + sum(CASE WHEN round(r.effect, 9) <= round(p.effect, 9) THEN 1e0 ELSE 0e0 END)) / (2e0 * count(*)))), 9) AS proportion
FROM reps r JOIN point p ON p.family = r.family GROUP BY r.family""")
C.query("bca_bias", "SELECT family, proportion FROM bias")
C.relation("bca_parts", """
SELECT p.family, round(p.effect, 9) AS effect, a.acceleration, a.n_blocks, b.proportion, r.reps FROM point p JOIN acceleration a ON a.family = p.family JOIN bias b ON b.family = p.family
JOIN (SELECT family, {list:round(effect, 9)} AS reps FROM reps GROUP BY family) r ON r.family = p.family""")
C.query("wild_t_pvalue", "SELECT family, round(t, 6) AS t, round(p_value, 9) AS p_value, n_valid, CASE WHEN n_valid < {=least_valid} THEN 'REFUSED' ELSE 'TESTED' END AS status FROM wild_p")
C.query("bh_qvalues", """
SELECT family, round(p_value, 9) AS p_value, round(least(1e0, min(p_value * m / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q_value
FROM (SELECT family, p_value, row_number() OVER (ORDER BY round(p_value, 12), family) AS i, count(*) OVER () AS m FROM wild_p) x""")

_TWO = """
SELECT family, n_q, n_c, round(uq / n_q - uc / n_c, 9) AS occupancy_effect, round(sq / nullif(uq, 0) - sc / nullif(uc, 0), 9) AS intensity_effect, round(sq / n_q - sc / n_c, 9) AS total_effect, uq AS used_query, uc AS used_comparator
FROM (SELECT x.family, max(nq) AS n_q, max(nc) AS n_c, sum(CASE WHEN side = 'F' AND {use} THEN 1e0 ELSE 0e0 END) AS uq, sum(CASE WHEN side = 'O' AND {use} THEN 1e0 ELSE 0e0 END) AS uc,
             sum(CASE WHEN side = 'F' AND {use} THEN signed ELSE 0e0 END) AS sq, sum(CASE WHEN side = 'O' AND {use} THEN signed ELSE 0e0 END) AS sc
      FROM (SELECT rf.*, sum(mass) OVER (PARTITION BY region_id) AS budget, (SELECT nq FROM sides) AS nq, (SELECT nc FROM sides) AS nc FROM rf WHERE rf.side IN ('F', 'O')) x WHERE nq > 0 AND nc > 0 GROUP BY x.family HAVING sum(n_hits) > 0) t"""
C.query("two_part_any_hit", _TWO.replace("{use}", "n_hits > 0"))
C.query("two_part_contribution_floor", _TWO.replace("{use}", "n_hits > 0 AND mass >= {=floor_mass}"))
C.query("two_part_budget_fraction", _TWO.replace("{use}", "n_hits > 0 AND budget > 0 AND mass >= {=budget_share} * budget"))
