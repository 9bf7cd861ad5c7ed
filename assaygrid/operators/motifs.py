"""Small matrices: cores, information, reverse complements, pairs and why they are left out; annotation candidates and family consensus."""

from __future__ import annotations

from ..plans.relations import CATALOGUE as C
from .registration import LEAST_ROWS, LEAST_SHARE, TRIM

C.relation("cells", "SELECT vec_id AS node_id, CAST(floor(i / 4) AS BIGINT) AS pos, CAST(i % 4 AS BIGINT) AS base, v FROM {cells:embeddings:vec_id} z")
C.relation("rows_", "SELECT node_id, pos, max(abs(v)) AS top, sum(abs(v)) AS mass FROM cells GROUP BY node_id, pos")
C.relation("core", f"""
SELECT r.node_id, min(pos) AS core_start, max(pos) + 1 AS core_end FROM rows_ r JOIN (SELECT node_id, max(top) AS top FROM rows_ GROUP BY node_id) t ON t.node_id = r.node_id AND r.top >= {TRIM} * t.top GROUP BY r.node_id""")
C.query("trim_core", "SELECT node_id, core_start, core_end, core_end - core_start AS core_length FROM core")
C.query("core_information", """
SELECT x.node_id, round(sum(CASE WHEN p > 0 THEN p * ln(p) / ln(2e0) ELSE 0 END) + 2e0 * count(DISTINCT x.pos), 6) AS information FROM
  (SELECT c.node_id, c.pos, abs(c.v) / r.mass AS p FROM cells c JOIN rows_ r ON r.node_id = c.node_id AND r.pos = c.pos AND r.mass > 0) x
JOIN core k ON k.node_id = x.node_id AND x.pos >= k.core_start AND x.pos < k.core_end GROUP BY x.node_id""")
C.query("reverse_complement_cells", "SELECT c.node_id, m.n - 1 - c.pos AS pos, 3 - c.base AS base, round(c.v, 9) AS v FROM cells c JOIN (SELECT node_id, max(pos) + 1 AS n FROM cells GROUP BY node_id) m ON m.node_id = c.node_id")
C.query("motif_completeness", """
SELECT k.node_id, round((core_end - core_start) * 1e0 / n, 9) AS completeness FROM core k JOIN (SELECT node_id, max(pos) + 1 AS n FROM cells GROUP BY node_id) m ON m.node_id = k.node_id""")

# Pairs: the shorter core has at least LEAST_ROWS rows and LEAST_SHARE of the longer one's.  Motifs of one length are dealt into
# slots, of 256 to 4096 as they grow: a motif travels once for each slot; two slots meet by key where their lengths may, each pair of
# motifs once.  A motif that cannot be registered has length 0.  Pairs are counted from the lengths alone.
C.relation("motif_status", """
SELECT e.vec_id AS node, CASE WHEN embedding IS NULL OR {len:embedding} = 0 OR {len:embedding} % 4 <> 0 THEN 'no_ppm_array' WHEN k.node_id IS NULL THEN 'no_declared_trimmed_core' ELSE 'registrable' END AS status,
       core_end - core_start AS core_bp FROM embeddings e LEFT JOIN core k ON k.node_id = e.vec_id""", stored=True)
# the same motifs cut to lengths of 4 to 16 rows, some without a core
C.relation("cut_status", """
SELECT node, CASE WHEN status = 'registrable' AND node % 17 = 0 THEN 'no_declared_trimmed_core' ELSE status END AS status, CASE WHEN node % 17 > 0 THEN least(core_bp, 4 + node % 13) END AS core_bp FROM motif_status""", stored=True)


def _pairs(of: str, named: str) -> None:
    """Relations and queries on the pairs of the motifs of a relation."""
    C.relation(f"{named}sized", f"SELECT node, status, core_bp, CASE WHEN status = 'registrable' THEN core_bp ELSE 0 END AS l FROM {of}")
    C.relation(f"{named}lens", f"SELECT l, count(*) AS n, CAST(ceil(count(*) / least(4096e0, greatest(256e0, count(*) / 16e0))) AS BIGINT) AS k FROM {named}sized GROUP BY l")
    C.relation(f"{named}len_pairs", f"""
SELECT x.l AS a, x.k AS ka, x.n AS na, y.l AS b, y.k AS kb, y.n AS nb, CASE WHEN y.l = 0 THEN 'node_not_registrable' WHEN y.l < {LEAST_ROWS} OR y.l < {LEAST_SHARE} * x.l THEN 'no_offset_meets_overlap_floor' END AS exclusion
FROM (SELECT l, k, n, {{explode:l + 1}} AS o FROM {named}lens) x JOIN {named}lens y ON y.l = x.o""")
    C.relation(f"{named}placed", f"""
SELECT s.node, s.status, s.core_bp, s.l, {{hex:concat_ws('|', 'slot', CAST(s.node AS VARCHAR(20)))}} % z.k AS slot FROM {named}sized s JOIN {named}lens z ON z.l = s.l""")
    long = f"SELECT p.node, p.status, p.core_bp, q.a, q.b, q.exclusion, p.slot AS sa, {{explode:q.kb}} AS sb FROM {named}placed p JOIN {named}len_pairs q ON q.a = p.l AND q.exclusion"
    short = f"SELECT p.node, p.status, p.core_bp, q.a, q.b, {{explode:q.ka}} AS sa, p.slot AS sb FROM {named}placed p JOIN {named}len_pairs q ON q.b = p.l AND q.exclusion"
    for name, kept in (("pair_candidates", "IS NULL"), ("excluded_pairs", "IS NOT NULL")):
        ends = ", ".join(f"CASE WHEN x.node < y.node THEN {p}.{c} ELSE {o}.{c} END AS {side}{as_}" for c, as_ in (("node", ""), ("status", "_status"), ("core_bp", "_core_bp")) for side, p, o in (("source", "x", "y"), ("target", "y", "x")))
        C.relation(f"{named}{name}_", f"SELECT {ends}, x.exclusion FROM ({long} {kept}) x JOIN ({short} {kept}) y ON y.a = x.a AND y.b = x.b AND y.sa = x.sa AND y.sb = x.sb AND (x.a > x.b OR x.sa > x.sb OR (x.sa = x.sb AND x.node < y.node))")
    C.query(f"{named}pair_candidates", f"SELECT source, target, source_core_bp, target_core_bp FROM {named}pair_candidates_")
    C.query(f"{named}excluded_pairs", f"SELECT source, target, exclusion, source_status, target_status, source_core_bp, target_core_bp FROM {named}excluded_pairs_")
    C.query(f"{named}exclusion_histogram", f"""
SELECT v.kind, v.reason, coalesce(n, 0) AS n FROM (VALUES ('pair', 'node_not_registrable'), ('pair', 'no_offset_meets_overlap_floor'), ('pair', 'considered'), ('node', 'registrable'), ('node', 'no_ppm_array'), ('node', 'no_declared_trimmed_core')) AS v(kind, reason)
LEFT JOIN (SELECT 'pair' AS kind, exclusion AS reason, CAST(sum(CASE WHEN a = b THEN na * (na - 1) / 2 ELSE na * nb END) AS BIGINT) AS n FROM {named}len_pairs WHERE exclusion IS NOT NULL GROUP BY exclusion
  UNION ALL SELECT 'pair' AS kind, 'considered' AS reason, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n FROM {named}sized UNION ALL SELECT 'node' AS kind, status AS reason, count(*) AS n FROM {of} GROUP BY status) g ON g.kind = v.kind AND g.reason = v.reason""")
    # written apart: all pairs of the motifs, read off the arrays
    cut = "CASE WHEN vec_id % 17 > 0 THEN least(core, 4 + vec_id % 13) END" if named else "core"
    every = f"""
WITH one AS (SELECT vec_id AS node, coalesce(len(embedding), 0) > 0 AND len(embedding) % 4 = 0 AS ppm, list_transform(range(0, len(embedding) // 4), lambda i: list_max(list_transform(embedding[i * 4 + 1:i * 4 + 4], lambda v: abs(CAST(v AS DOUBLE))))) AS top FROM embeddings),
two AS (SELECT node AS vec_id, ppm, list_filter(range(0, len(top)), lambda i: top[i + 1] >= {TRIM} * list_max(top)) AS kept FROM one),
m AS (SELECT vec_id AS node, {cut} AS core_bp, CASE WHEN NOT ppm THEN 'no_ppm_array' WHEN {cut} IS NULL THEN 'no_declared_trimmed_core' ELSE 'registrable' END AS status FROM (SELECT *, list_max(kept) - list_min(kept) + 1 AS core FROM two) t),
p AS (SELECT x.node AS source, y.node AS target, x.status AS source_status, y.status AS target_status, x.core_bp AS source_core_bp, y.core_bp AS target_core_bp,
  CASE WHEN 'registrable' <> x.status OR 'registrable' <> y.status THEN 'node_not_registrable' WHEN NOT (x.core_bp >= {LEAST_ROWS} AND y.core_bp >= {LEAST_ROWS} AND x.core_bp >= {LEAST_SHARE} * y.core_bp AND y.core_bp >= {LEAST_SHARE} * x.core_bp) THEN 'no_offset_meets_overlap_floor' END AS exclusion
  FROM m x JOIN m y ON x.node < y.node)"""
    C.check(f"{named}pair_candidates", every + " SELECT source, target, source_core_bp, target_core_bp FROM p WHERE exclusion IS NULL")
    C.check(f"{named}excluded_pairs", every + " SELECT source, target, exclusion, source_status, target_status, source_core_bp, target_core_bp FROM p WHERE exclusion IS NOT NULL")
    C.check(f"{named}exclusion_histogram", every + """
SELECT kind, reason, count(n) AS n FROM (VALUES ('pair', 'node_not_registrable'), ('pair', 'no_offset_meets_overlap_floor'), ('pair', 'considered'), ('node', 'registrable'), ('node', 'no_ppm_array'), ('node', 'no_declared_trimmed_core')) AS v(kind, reason)
LEFT JOIN (SELECT 'pair' AS kind, exclusion AS reason, 1 AS n FROM p UNION ALL SELECT 'pair', 'considered', 1 FROM p UNION ALL SELECT 'node', status, 1 FROM m) x USING (kind, reason) GROUP BY kind, reason""")


_pairs("motif_status", "")
_pairs("cut_status", "cut_")

# Annotation: one candidate for each node, source and matched motif, named by its content.
C.relation("cand", """
SELECT node_id, source, matched, q, CASE WHEN node_id % 11 > 0 THEN 4 + node_id % 12 END AS core_length, CASE WHEN node_id % 13 > 0 THEN node_id * 37 % 300 END AS seqlets FROM
  (SELECT user_id AS node_id, CASE event_id % 3 WHEN 0 THEN 'TomTom' WHEN 1 THEN 'homer' ELSE 'database' END AS source, event_type AS matched, min(value) AS q
   FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, CASE event_id % 3 WHEN 0 THEN 'TomTom' WHEN 1 THEN 'homer' ELSE 'database' END, event_type) e""")
C.relation("vocabulary", "SELECT * FROM (VALUES ('click', 'T1'), ('view', 'T1'), ('purchase', 'T2'), ('signup', 'T2')) AS v(matched, fam)")
C.relation("vocab", "SELECT c.node_id, c.source, c.matched, v.fam FROM cand c LEFT JOIN vocabulary v ON v.matched = c.matched")
C.query("annotation_candidates", """
SELECT node_id, source, matched, round(q, 6) AS q,
       concat('annotation:', {sha:concat(chr(123), '"matched_motif_id":"', matched, '","node_id":"', CAST(node_id AS VARCHAR(20)), '","source":"', source, '","source_version":"1"', chr(125))}) AS candidate_id FROM cand""")
C.query("annotation_low_confidence", """
SELECT node_id, source, matched, coalesce(core_length <= 6, false) OR coalesce(lower(source) = 'tomtom' AND q > 0.05, false) OR coalesce(seqlets < 100, false) AS low_confidence FROM cand""")
C.relation("occurrence", "SELECT node_id, source, matched, 1e0 / (1 + node_id % 40) AS p FROM cand WHERE node_id % 2 = 0")
C.query("occurrence_null", """
SELECT c.node_id, c.source, c.matched, round(o.p, 9) AS occurrence_null FROM cand c LEFT JOIN occurrence o ON o.node_id = c.node_id AND o.source = c.source AND o.matched = c.matched""")
C.query("family_consensus", """
SELECT node_id, n_candidates, n_resolved, CASE WHEN n_candidates = 0 THEN 'NO_CANDIDATE' WHEN n_resolved = 0 THEN 'UNDECLARED' WHEN top < 2 AND n_resolved < 2 THEN 'TOO_FEW' WHEN top < 2 OR n_top > 1 THEN 'SPLIT' WHEN n_families = 1 THEN 'UNANIMOUS' ELSE 'MAJORITY' END AS state,
       CASE WHEN top >= 2 AND n_top = 1 THEN best END AS family
FROM (SELECT a.node_id, a.n_candidates, a.n_resolved, coalesce(t.top, 0) AS top, coalesce(t.n_top, 0) AS n_top, coalesce(t.n_families, 0) AS n_families, t.best
      FROM (SELECT u.node_id, count(v.matched) AS n_candidates, count(v.fam) AS n_resolved FROM (SELECT c_custkey AS node_id FROM customer UNION SELECT node_id FROM cand) u LEFT JOIN vocab v ON v.node_id = u.node_id GROUP BY u.node_id) a
      LEFT JOIN (SELECT node_id, max(top) AS top, sum(CASE WHEN n = top THEN 1 ELSE 0 END) AS n_top, count(*) AS n_families, min(CASE WHEN n = top THEN fam END) AS best
                 FROM (SELECT node_id, fam, n, max(n) OVER (PARTITION BY node_id) AS top FROM (SELECT node_id, fam, count(*) AS n FROM vocab WHERE fam IS NOT NULL GROUP BY node_id, fam) g) w GROUP BY node_id) t ON t.node_id = a.node_id) z""")
