"""Adjudication under criteria against loops over clusters, with annotation, stability and missing evidence."""

import itertools
import json
import random

import pytest

from assaygrid.functions.identity import decision_id
from assaygrid.operators.criteria import FROZEN, HEURISTIC, UNDEFINED, Criterion, Predicate
from assaygrid.operators.evidence import adjudicate_under
from assaygrid.sources.readers import Refusal

EDGE = "u long, v long, overlap_frac_source double, overlap_frac_target double, overlap_bp long, ppm_similarity double, signed_cwm_similarity double, empirical_p_value double"
MOTIF = "node long, family string, variant string, variant_source string, completeness double, seqlets long, core_ic double, recurrence int"
end = lambda f, e: {"evidence_domain": f, "endpoint": e}
RULES = {c.criterion_id: c for c in (
    Criterion("DUP", "2", HEURISTIC, "TRUE_DUPLICATE", ("ppm_similarity", "signed_cwm_similarity", "n_affected_peaks"), (Predicate("ppm_similarity", "ge", 0.9, "declared", "chosen"), Predicate("signed_cwm_similarity", "ge", 0.0, "derived", "same sign", end("signed_cwm_similarity", "sign_boundary")), Predicate("n_affected_peaks", "le", 10, "declared", "chosen")), decision_if_matched="collapse", declared_rationale="say so"),
    Criterion("VAR", "1", FROZEN, "SAME_FAMILY_VARIANT", ("same_family", "distinct_variant_ids"), (Predicate("same_family", "is_true"), Predicate("distinct_variant_ids", "is_true")), decision_if_matched="refuse_merge"),
    Criterion("FRAG", "1", UNDEFINED, "FRAGMENT_MATCH", ("overlap_frac_source",)),
    Criterion("AMB", "1", FROZEN, "AMBIGUOUS_CROSS_FAMILY", ("family_conflict",), (Predicate("family_conflict", "is_true"),), decision_if_matched="refuse_merge"),
)}


def made(rng):
    edges, motifs, candidates = [], [], []
    for c in range(40):
        k = rng.randint(2, 4)
        nodes = [c * 10 + i for i in range(k)]
        family = rng.choice(["F", "G", None])
        named = rng.random() < 0.4
        for n in nodes:
            motifs.append((n, family if rng.random() < 0.9 else "NA", f"v{rng.randint(0, 1)}" if named else None, "curated" if named and rng.random() < 0.95 else None, rng.choice([0.5, 0.9]), rng.randint(1, 3), 1.0, rng.choice([1, None])))
            if rng.random() < 0.3:
                candidates.append((n, rng.choice(["F", "F", "H"]), rng.random() < 0.5))
        for u, v in itertools.combinations(nodes, 2):
            if k < 3 or rng.random() < 0.9:
                whole = rng.random() < 0.85
                edges.append((u, v, 1.0 if whole else 0.7, 1.0, 9, rng.choice([0.85, 0.92, 0.95]), rng.choice([0.5, 0.6, -0.2]), 0.05))
    return edges, motifs, candidates


def clusters(edges):
    near = {}
    for e in edges:
        near.setdefault(e[0], set()).add(e[1])
        near.setdefault(e[1], set()).add(e[0])
    out, left = [], set(near)
    while left:
        own, todo = set(), [min(left)]
        while todo:
            n = todo.pop()
            if n not in own:
                own.add(n)
                todo += near[n]
        left -= own
        out.append(tuple(sorted(own)))
    return out


def plain(nodes, edges, motifs, candidates, stability):
    """(decision id, relationship, decision) of one cluster."""
    own, at = {m[0]: m for m in motifs}, {e[:2]: e for e in edges}
    families = {n: {own[n][1]} - {None, "NA"} | {f for c, f, low in candidates if c == n and not low} for n in nodes}
    every = set().union(*families.values())
    variants = [own[n][2] for n in nodes if own[n][2]]
    distinct = len(set(variants)) > 1 if len(variants) == len(nodes) else None
    pairs = {p: at[p] for p in itertools.combinations(nodes, 2) if p in at}
    rel = "AMBIGUOUS_CROSS_FAMILY" if len(every) > 1 else "SAME_FAMILY_VARIANT" if len(every) == 1 and distinct else "FRAGMENT_MATCH" if any(e[2] < 1 or e[3] < 1 for e in pairs.values()) else "TRUE_DUPLICATE"
    rule = next(c for c in RULES.values() if c.relationship == rel)
    ident = decision_id([str(n) for n in nodes], rel, rule.criterion_id, rule.version)
    if len(pairs) < len(nodes) * (len(nodes) - 1) // 2:
        return ident, rel, "deferred"
    if rel == "AMBIGUOUS_CROSS_FAMILY":
        return ident, rel, "refuse_merge"
    if rel == "SAME_FAMILY_VARIANT":
        return ident, rel, "refuse_merge"  # both evidences are there, and either way it refuses
    mean = {n: round(sum(e[5] for p, e in pairs.items() if n in p) / (len(nodes) - 1), 9) for n in nodes}
    tied = [n for n in nodes if mean[n] == max(mean.values())]
    for i in (4, 5, 6, 7):
        if len(tied) < 2:
            break
        if any(own[n][i] is None for n in tied):
            return ident, rel, "deferred"
        tied = [n for n in tied if own[n][i] == max(own[m][i] for m in tied)]
    medoid = min(tied)
    if rel == "FRAGMENT_MATCH" or ident not in stability:
        return ident, rel, "deferred"
    ok = all(e[5] >= 0.9 and e[6] >= 0 and stability[ident] <= 10 for p, e in pairs.items() if medoid in p)
    return ident, rel, "collapse" if ok else "refuse_merge"


def test_clusters_under_criteria(spark):
    rng = random.Random(12)
    edges, motifs, candidates = made(rng)
    tight = [e for e in edges if e[5] >= 0.9]
    proposals = [("wide", c) for c in clusters(edges)]
    proposals += [("tight", c) for c in clusters(tight) if ("wide", c) not in proposals]
    stability = {plain(c, edges, motifs, candidates, {})[0]: rng.choice([0, 10, 11]) for _, c in proposals if rng.random() < 0.7}
    want = sorted((name, c, *plain(c, edges, motifs, candidates, stability)) for name, c in proposals)
    results = spark.createDataFrame([(k, "STABLE_AFFECTED_SUBSET", v) for k, v in stability.items()], "decision_id string, status string, n_affected_peaks long")
    e, m = spark.createDataFrame(edges, EDGE), spark.createDataFrame(motifs, MOTIF)
    given = spark.createDataFrame(candidates, "node long, family string, low_confidence_annotation boolean")
    rows = adjudicate_under(RULES, e, m, given, results).collect()
    got = sorted((r["pass"], tuple(sorted(int(n) for n in json.loads(r.members))), r.decision_id, r.relationship, r.decision) for r in rows)
    assert got == want
    assert {r.decision for r in rows} == {"collapse", "refuse_merge", "deferred"} and len({r.relationship for r in rows}) == 4
    assert all((r.representative is None) == (r.decision != "collapse") and r.rationale for r in rows)
    for bad in (lambda: adjudicate_under({k: c for k, c in RULES.items() if k != "AMB"}, e, m, given, results), lambda: adjudicate_under(RULES, e, m, given.limit(1).selectExpr("-5L AS node", "family", "low_confidence_annotation"), results), lambda: adjudicate_under(RULES, e, m, given, results.unionAll(results))):
        with pytest.raises(Refusal):
            bad()


def test_the_stage_reads_criteria_candidates_and_stability(spark, tmp_path):
    from assaygrid.cli import main
    from assaygrid.sources import manifests, publish

    (tmp_path / "c.yaml").write_text("""
schema_version: 2
criteria:
  - {criterion_id: DUP, version: 2, status: FROZEN_DECLARED_HEURISTIC, relationship: TRUE_DUPLICATE, required_evidence: [ppm_similarity, n_affected_peaks], decision_if_matched: collapse, declared_rationale: near copies,
     predicates: [{field: ppm_similarity, operator: ge, value: 0.9, provenance: declared, basis: chosen}, {field: n_affected_peaks, operator: le, value: 10, provenance: declared, basis: chosen}]}
  - {criterion_id: AMB, version: 1, status: FROZEN, relationship: AMBIGUOUS_CROSS_FAMILY, required_evidence: [family_conflict], decision_if_matched: refuse_merge, predicates: [{field: family_conflict, operator: is_true}]}
""")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name)) or str(tmp_path / name)
    edges = put("e", [(1, 2, 1.0, 1.0, 9, 0.95, 0.5, 0.05), (3, 4, 1.0, 1.0, 9, 0.95, 0.5, 0.05), (5, 6, 1.0, 1.0, 9, 0.95, 0.5, 0.05)], EDGE)
    motifs = put("m", [(n, "F", None, None, 0.5, n, 1.0, 1) for n in range(1, 7)], MOTIF)
    named = put("a", [(6, "G", False), (2, "H", True)], "node long, family string, low_confidence_annotation boolean")
    ids = {n: decision_id([str(n), str(n + 1)], "TRUE_DUPLICATE", "DUP", "2") for n in (1, 3)}
    (tmp_path / "s.json").write_text(json.dumps([{"decision_id": ids[1], "status": "STABLE_AFFECTED_SUBSET", "n_affected_peaks": 3}]))
    run = lambda out, *more: main(["adjudicate", edges, "--motifs", motifs, *more, "--out", str(tmp_path / out)], spark)
    assert run("out", "--criteria", str(tmp_path / "c.yaml"), "--candidates", named, "--stability", str(tmp_path / "s.json")) == 0
    got = {tuple(r.members): (r.decision, r.representative, r.cluster_id) for r in manifests.read_decisions(spark, tmp_path / "out" / "merge_decisions.json").collect()}
    assert got[("1", "2")] == ("collapse", "2", ids[1]) and got[("3", "4")] == ("deferred", None, ids[3]) and got[("5", "6")][0] == "refuse_merge"
    assert publish.about(spark.read.parquet(str(tmp_path / "out" / "ontology_decisions.parquet")))["provenance"]["criteria"].endswith("c.yaml")
    assert run("out2", "--stability", str(tmp_path / "s.json")) == 4 and run("out", "--criteria", str(tmp_path / "c.yaml")) == 4
