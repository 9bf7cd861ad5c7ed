"""Before and after: which hits changed, in which regions, and how much the rest did; splits of regions by role.

Two hit tables, each with one coefficient for a (peak, hit) and one reconstruction for a peak, meet in a full outer
join.  A peak is affected if a hit is on one side only, or if a shared one moved by more than the tolerance.
Medians come from exact ranks over sampled ranges (``selection``), so no buffer holds a column.
"""

from __future__ import annotations

from ..functions.identity import affected_text
from ..plans.relations import CATALOGUE as C

TOLERANCE = 3.63e-07  # fixed value: accuracy floor of a coefficient
LEAST = 30  # fixed value: affected peaks below which nothing is claimed
C.relation("base_hits", """
SELECT l_orderkey AS peak, l_partkey * 10 + l_linenumber AS hit, min(p_size) AS size, round(sum(l_extendedprice * (1 - l_discount) / 1000), 9) AS coef
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey * 10 + l_linenumber""", stored=True)
# the two tables: some motifs are dropped, some are new, some are fitted again with a jitter, some move
C.relation("before_hits", "SELECT peak, hit, coef FROM base_hits WHERE size < 49")
C.relation("after_hits", "SELECT peak, hit, CASE WHEN size <= 10 THEN coef + 1e-9 WHEN size <= 12 THEN coef + 1e-3 ELSE coef END AS coef FROM base_hits WHERE size > 2")
C.relation("before_peaks", "SELECT o_orderkey AS peak, o_totalprice / 1000 AS recon FROM orders")
C.relation("after_peaks", "SELECT o_orderkey AS peak, o_totalprice / 1000 - CASE WHEN o_orderkey % 4 = 0 THEN 5e-3 ELSE 0 END AS recon FROM orders")
C.relation("both_hits", "SELECT coalesce(b.peak, a.peak) AS peak, coalesce(b.hit, a.hit) AS hit, b.coef AS old, a.coef AS new FROM before_hits b FULL OUTER JOIN after_hits a ON a.peak = b.peak AND a.hit = b.hit")
C.relation("flagged", f"SELECT *, CASE WHEN old IS NULL OR new IS NULL OR abs(new - old) > {TOLERANCE!r} THEN 1 ELSE 0 END AS affected FROM both_hits")
C.relation("hit_sums", """
SELECT peak, max(affected) AS affected, sum(affected) AS changed_hits, count(*) AS n_union, sum(CASE WHEN old IS NOT NULL AND new IS NOT NULL THEN 1 ELSE 0 END) AS n_shared, sum(coalesce(abs(new), 0)) AS mass,
       sum(CASE WHEN old IS NOT NULL THEN new END) AS sn, sum(CASE WHEN new IS NOT NULL THEN old END) AS so, sum(new * old) AS sno, sum(CASE WHEN old IS NOT NULL THEN new * new END) AS snn, sum(CASE WHEN new IS NOT NULL THEN old * old END) AS soo
FROM flagged GROUP BY peak""")
C.relation("peak_change", """
SELECT h.*, round(a.recon - b.recon, 9) AS delta FROM hit_sums h JOIN before_peaks b ON b.peak = h.peak JOIN after_peaks a ON a.peak = h.peak""", stored=True)
C.query("stability_affected", "SELECT peak, affected, changed_hits, delta FROM peak_change")
C.query("reconstruction_coverage", """
SELECT sum(CASE WHEN b.peak IS NULL THEN 1 ELSE 0 END) AS only_after, sum(CASE WHEN a.peak IS NULL THEN 1 ELSE 0 END) AS only_before, count(*) AS n_peaks, round(sum(coalesce(a.recon, 0) - coalesce(b.recon, 0)), 3) AS total_delta
FROM before_peaks b FULL OUTER JOIN after_peaks a ON a.peak = b.peak""")
C.query("duplicate_identities", """
SELECT side, count(*) AS n_rows, sum(n) - count(*) AS n_repeated, sum(bad) AS n_not_finite FROM
  (SELECT 'before' AS side, peak, hit, count(*) AS n, sum(CASE WHEN coef IS NULL THEN 1 ELSE 0 END) AS bad FROM before_hits GROUP BY peak, hit
   UNION ALL SELECT 'after' AS side, peak, hit, count(*) AS n, sum(CASE WHEN coef IS NULL THEN 1 ELSE 0 END) AS bad FROM after_hits GROUP BY peak, hit) x GROUP BY side""")


C.relation("delta_v", "SELECT 'all' AS grp, delta, count(*) AS n FROM peak_change GROUP BY delta UNION ALL SELECT 'affected' AS grp, delta, count(*) AS n FROM peak_change WHERE affected = 1 GROUP BY delta", stored=True)
C.relation("delta_k", "SELECT grp, delta, n, upto, total FROM {ranked:delta_v} k")
C.relation("delta_m", "SELECT grp, avg(delta) AS middle FROM delta_k WHERE upto > (total - 1) / 2e0 AND upto - n <= total / 2e0 GROUP BY grp")
C.relation("summed", """
SELECT sum(affected) AS n_affected, count(*) AS n_peaks, sum(CASE WHEN affected = 1 THEN n_union ELSE 0 END) AS n_hits, coalesce(sum(CASE WHEN affected = 1 THEN mass ELSE 0 END) / nullif(sum(mass), 0), 0) AS share,
       sum(CASE WHEN affected = 1 THEN n_shared ELSE 0 END) * 1e0 AS n, nullif(sum(CASE WHEN affected = 1 THEN n_union END), 0) AS u, sum(CASE WHEN affected = 1 THEN sn END) AS sn, sum(CASE WHEN affected = 1 THEN so END) AS so,
       sum(CASE WHEN affected = 1 THEN sno END) AS sno, sum(CASE WHEN affected = 1 THEN snn END) AS snn, sum(CASE WHEN affected = 1 THEN soo END) AS soo FROM peak_change""")
C.query("stability_summary", f"""
SELECT n_affected, n_hits AS n_affected_hits, n_peaks, round(share, 9) AS affected_mass_share, round(n / u, 9) AS jaccard,
       CASE WHEN n >= 2 AND n * snn > sn * sn AND n * soo > so * so THEN round((n * sno - sn * so) / (sqrt(n * snn - sn * sn) * sqrt(n * soo - so * so)), 6) END AS pearson,
       round(ma, 9) AS median_delta_affected, round(mall, 9) AS median_delta_all, '{affected_text(TOLERANCE)}' AS affected_definition,
       CASE WHEN n_affected < {LEAST} THEN 'LOW_RISK_RARE_NOT_VALIDATED' WHEN abs(ma) <= 1e-12 THEN 'STABLE_AFFECTED_SUBSET' ELSE 'CHANGED_AFFECTED_SUBSET' END AS status
FROM (SELECT s.*, (SELECT middle FROM delta_m WHERE grp = 'affected') AS ma, (SELECT middle FROM delta_m WHERE grp = 'all') AS mall FROM summed s) x""")
C.check("stability_summary", f"""
WITH base AS (SELECT l_orderkey AS peak, l_partkey * 10 + l_linenumber AS hit, min(p_size) AS size, round(sum(l_extendedprice * (1 - l_discount) / 1000), 9) AS coef FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
j AS (SELECT coalesce(b.peak, a.peak) AS peak, b.coef AS o, a.coef AS w FROM (FROM base WHERE size < 49) b FULL JOIN (SELECT peak, hit, coef + CASE WHEN size <= 10 THEN 1e-9 WHEN size <= 12 THEN 1e-3 ELSE 0 END AS coef FROM base WHERE size > 2) a USING (peak, hit)),
p AS (SELECT peak, bool_or(o IS NULL OR w IS NULL OR abs(w - o) > {TOLERANCE!r}) AS hot FROM j GROUP BY peak),
d AS (SELECT p.*, round((o_totalprice / 1000 - CASE WHEN o_orderkey % 4 = 0 THEN 5e-3 ELSE 0 END) - o_totalprice / 1000, 9) AS delta FROM p JOIN orders ON o_orderkey = peak)
SELECT (SELECT count(*) FROM d WHERE hot) AS n_affected, (SELECT count(*) FROM j JOIN p USING (peak) WHERE hot) AS n_affected_hits, (SELECT count(*) FROM d) AS n_peaks,
       (SELECT round(sum(abs(w)) FILTER (hot) / sum(abs(w)), 9) FROM j JOIN p USING (peak)) AS affected_mass_share, (SELECT round(count(*) FILTER (o IS NOT NULL AND w IS NOT NULL) / count(*), 9) FROM j JOIN p USING (peak) WHERE hot) AS jaccard,
       (SELECT round(corr(o, w), 6) FROM j JOIN p USING (peak) WHERE hot) AS pearson, (SELECT round(median(delta), 9) FROM d WHERE hot) AS median_delta_affected, (SELECT round(median(delta), 9) FROM d) AS median_delta_all,
       '{affected_text(TOLERANCE)}' AS affected_definition,
       (SELECT CASE WHEN count(*) < {LEAST} THEN 'LOW_RISK_RARE_NOT_VALIDATED' WHEN abs(median(delta)) <= 1e-12 THEN 'STABLE_AFFECTED_SUBSET' ELSE 'CHANGED_AFFECTED_SUBSET' END FROM d WHERE hot) AS status""")
C.query("hit_symmetric_difference", "SELECT peak, hit, CASE WHEN new IS NULL THEN 'dropped' ELSE 'gained' END AS change FROM both_hits WHERE old IS NULL OR new IS NULL")
C.check("hit_symmetric_difference", """
WITH base AS (SELECT DISTINCT l_orderkey AS peak, l_partkey * 10 + l_linenumber AS hit, p_size AS size FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT peak, hit, 'dropped' AS change FROM (SELECT peak, hit FROM base WHERE size < 49 EXCEPT SELECT peak, hit FROM base WHERE size > 2) x
UNION ALL SELECT peak, hit, 'gained' AS change FROM (SELECT peak, hit FROM base WHERE size > 2 EXCEPT SELECT peak, hit FROM base WHERE size < 49) y""")
# the middle of the changed coefficients is the upper one, not a mean of two
C.relation("moved", f"SELECT 'moved' AS grp, round(abs(new - old), 9) AS delta, count(*) AS n FROM both_hits WHERE abs(new - old) > {TOLERANCE!r} GROUP BY round(abs(new - old), 9)")
C.relation("moved_k", "SELECT grp, delta, n, upto, total FROM {ranked:moved} k")
C.query("run_comparison", """
SELECT s.*, (SELECT max(delta) FROM moved_k WHERE upto > floor(total / 2e0) AND upto - n <= floor(total / 2e0)) AS upper_median FROM
  (SELECT sum(CASE WHEN new IS NULL THEN 1 ELSE 0 END) AS dropped, sum(CASE WHEN old IS NULL THEN 1 ELSE 0 END) AS gained, round(sum(CASE WHEN new IS NOT NULL AND old IS NOT NULL THEN 1e0 ELSE 0e0 END) / count(*), 9) AS jaccard,
          round(max(abs(new - old)), 9) AS max_delta FROM both_hits) s""")
C.relation("roles", """
SELECT region_id, side, {hex:concat_ws('|', 'split', CAST(region_id AS VARCHAR(20)))} % 4 AS fold FROM peaks""")
C.query("split_roles_check", """
SELECT CASE fold WHEN 0 THEN 'DISCOVERY' WHEN 1 THEN 'ADJUDICATION' WHEN 2 THEN 'VALIDATION' ELSE 'INFERENCE' END AS role, count(*) AS n_regions, count(DISTINCT region_id) AS n_distinct,
       sum(CASE WHEN fold = 2 THEN 1 ELSE 0 END) AS validation_regions FROM roles GROUP BY fold""")
C.query("crossfit_partition", "SELECT CAST(fold AS BIGINT) AS fold, evaluated, CAST(sum(evaluated) OVER () - evaluated AS BIGINT) AS complement FROM (SELECT fold, count(*) AS evaluated FROM roles GROUP BY fold) f")
