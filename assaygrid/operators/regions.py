"""Regions: the four-state hit table, the region universe, health floors and family composition."""

from __future__ import annotations

from ..plans.relations import CATALOGUE as C

BLOCK = 20000
C.relation("regions", f"""
SELECT o_orderkey AS region_id, o_orderpriority AS chrom, o_orderkey * 100 AS start_bp, o_orderkey * 100 + 50 AS end_bp, o_orderstatus AS side,
       concat_ws(':', o_orderpriority, CAST(CAST(floor(o_orderkey * 100 / {BLOCK}) AS BIGINT) AS VARCHAR(20))) AS block
FROM orders""")
C.relation("hits", """
SELECT r.*, p_type AS family, p_brand AS variant, l_linenumber AS line,
       CASE WHEN l_discount >= 0.02 THEN (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice * (1 - l_discount) / 1000 END AS coefficient,
       CASE WHEN l_orderkey IS NULL THEN CASE WHEN side = 'P' THEN 'not_searched' ELSE 'no_sequence_match' END
            WHEN l_discount >= 0.02 THEN 'used' ELSE 'hit_below_floor' END AS state
FROM regions r LEFT JOIN lineitem ON l_orderkey = region_id LEFT JOIN part ON p_partkey = l_partkey""")
# Spark names the parts of narrow rows first, and regions come last: what is summed by region is then already together
C.spark("named_lines", """
SELECT l_orderkey, p_type AS family, p_brand AS variant, l_linenumber AS line, l_discount,
       CASE WHEN l_discount >= 0.02 THEN (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice * (1 - l_discount) / 1000 END AS coefficient
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
C.spark("hits", """
SELECT r.*, family, variant, line, coefficient,
       CASE WHEN l_orderkey IS NULL THEN CASE WHEN side = 'P' THEN 'not_searched' ELSE 'no_sequence_match' END
            WHEN l_discount >= 0.02 THEN 'used' ELSE 'hit_below_floor' END AS state
FROM regions r LEFT JOIN {dealt:named_lines} n ON l_orderkey = region_id""")
C.relation("peaks", """
SELECT region_id, min(chrom) AS chrom, min(start_bp) AS start_bp, min(end_bp) AS end_bp, min(side) AS side, min(block) AS block,
       max(CASE WHEN state <> 'not_searched' THEN 1 ELSE 0 END) AS searched, count(family) AS opportunities,
       sum(CASE WHEN state = 'used' THEN 1 ELSE 0 END) AS n_used, sum(abs(coefficient)) AS mass
FROM hits GROUP BY region_id""", stored=True)
C.relation("rf", """
SELECT region_id, family, min(side) AS side, min(block) AS block, sum(CASE WHEN state = 'used' THEN 1 ELSE 0 END) AS n_hits,
       coalesce(sum(coefficient), 0) AS signed, coalesce(sum(abs(coefficient)), 0) AS mass
FROM hits WHERE family IS NOT NULL GROUP BY region_id, family""", stored=True)
C.relation("sides", """
SELECT sum(CASE WHEN side = 'F' THEN 1 ELSE 0 END) AS nq, sum(CASE WHEN side = 'O' THEN 1 ELSE 0 END) AS nc FROM peaks WHERE searched = 1""")

C.query("hits_four_state", "SELECT state, count(*) AS n, count(DISTINCT region_id) AS n_regions FROM hits GROUP BY state")
C.query("hits_substrate_check", """
SELECT count(*) AS n_rows, count(DISTINCT region_id) AS n_regions, sum(CASE WHEN start_bp >= end_bp THEN 1 ELSE 0 END) AS bad_coordinates,
       sum(CASE WHEN state = 'used' AND (family IS NULL OR variant IS NULL OR coefficient IS NULL) THEN 1 ELSE 0 END) AS used_without_fields,
       sum(CASE WHEN state <> 'used' AND coefficient IS NOT NULL THEN 1 ELSE 0 END) AS unused_with_coefficient FROM hits""")
C.query("retained_coverage", """
SELECT side, count(*) AS n_opportunities, sum(CASE WHEN state <> 'not_searched' THEN 1 ELSE 0 END) AS n_searched, sum(CASE WHEN state = 'used' THEN 1 ELSE 0 END) AS n_retained,
       round(sum(CASE WHEN state = 'used' THEN 1e0 ELSE 0e0 END) / nullif(sum(CASE WHEN state <> 'not_searched' THEN 1 ELSE 0 END), 0), 9) AS coverage
FROM hits GROUP BY side""")
C.query("region_universe", "SELECT region_id, chrom, start_bp, end_bp, side, block, searched, n_used, round(coalesce(mass, 0), 7) AS mass FROM peaks")
C.query("region_family_mass", "SELECT region_id, family, n_hits, round(signed, 7) AS signed, round(mass, 7) AS mass FROM rf")
C.relation("health", """
SELECT side, count(*) AS n_regions, sum(searched) AS n_searched, count(DISTINCT CASE WHEN searched = 1 THEN block END) AS n_blocks,
       sum(searched) * 1e0 / count(*) AS coverage, sum(CASE WHEN n_used > 0 THEN 1e0 ELSE 0e0 END) / nullif(sum(searched), 0) AS explained
FROM peaks GROUP BY side""")
C.query("peak_health_query", """
SELECT side, n_regions, n_searched, n_blocks, round(coverage, 9) AS coverage, round(explained, 9) AS explained,
       concat_ws(',', CASE WHEN coverage < 0.9 THEN 'coverage' END, CASE WHEN n_blocks < 30 THEN 'blocks' END, CASE WHEN explained < 0.5 THEN 'explained' END) AS failed_floors
FROM health""")
C.query("contrast_health", """
SELECT count(*) AS union_blocks, sum(CASE WHEN q > 0 AND c > 0 THEN 1 ELSE 0 END) AS shared_blocks, sum(CASE WHEN q > 0 THEN 1 ELSE 0 END) AS query_blocks, sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS comparator_blocks
FROM (SELECT block, sum(CASE WHEN side = 'F' THEN 1 ELSE 0 END) AS q, sum(CASE WHEN side = 'O' THEN 1 ELSE 0 END) AS c FROM peaks WHERE searched = 1 AND side IN ('F', 'O') GROUP BY block) b""")
C.query("family_composition", """
SELECT family, sum(CASE WHEN n_hits > 0 THEN 1 ELSE 0 END) AS n_with_family, max(nq) AS n_searched, round(sum(CASE WHEN n_hits > 0 THEN 1e0 ELSE 0e0 END) / max(nq), 9) AS share_with_family,
       round(sum(signed) / max(nq), 9) AS mean_coefficient
FROM (SELECT rf.*, (SELECT nq FROM sides) AS nq FROM rf WHERE side = 'F') x WHERE nq > 0 GROUP BY family""")
C.query("heldout_restriction", """
SELECT side, role, count(*) AS n_regions, sum(searched) AS n_searched FROM
  (SELECT side, searched, CASE {hex:concat_ws('|', 'split', CAST(region_id AS VARCHAR(20)))} % 4 WHEN 0 THEN 'DISCOVERY' WHEN 1 THEN 'ADJUDICATION' WHEN 2 THEN 'VALIDATION' ELSE 'INFERENCE' END AS role FROM peaks WHERE side IN ('F', 'O')) s
WHERE role = 'INFERENCE' GROUP BY side, role""")
