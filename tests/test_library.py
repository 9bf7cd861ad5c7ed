"""The library beside the queries: planted truth, a failing fixture for every guard, refusals, artifacts read back."""

import json
import math

import pytest

from assaygrid.functions import identity
from assaygrid.operators import annotation, compiling, criteria, design, guards, reading, validation
from assaygrid.operators.intervals import bca_of
from assaygrid.sources import manifests, sinks
from assaygrid.sources.readers import HIT, Refusal, read_hits

SUB = "ab" * 32


def planted(blocks=42):
    """Blocks of four regions, query in even ones; family A +0.9 in the query, B alike on both sides."""
    rows = []
    for b in range(blocks):
        for r in range(4):
            reg, start = f"r{b}_{r}", b * 1_000_000 + r * 100
            for fam, coef in (("A", 1.0 if b % 2 == 0 else 0.1), ("B", 0.5 + 0.01 * (b // 2 % 3))):
                rows.append((reg, "chr1", start, start + 50, f"v{fam}", fam, coef, "used", 168, "L", SUB))
    rows.append(("u1", "chr2", 5, 9, None, None, None, "not_searched", 168, "L", SUB))
    rows.append(("u2", "chr2", 15, 19, None, "A", None, "no_sequence_match", 168, "L", SUB))
    return rows


def hits_of(spark, rows):
    return spark.createDataFrame(rows, HIT)


def sides(spark, blocks=42):
    ids = lambda odd: spark.createDataFrame([(f"r{b}_{r}",) for b in range(blocks) if b % 2 == odd for r in range(4)], "region_id string")
    return ids(0), ids(1)


LOW = reading.Floors(0.9, 20, 0.5)


def test_planted_effects(spark, tmp_path):
    hits, (q, c) = hits_of(spark, planted()), sides(spark)
    log = sinks.GuardLog("interpret", tmp_path)
    out = reading.interpret(hits, reading.Query("q", q, c, "base", "EXTERNAL"), LOW, n_bootstrap=100, usage="any_hit", log=log)
    effects = {e["family_id"]: e for e in out.effects}
    assert math.isclose(effects["A"]["effect"], 0.9, abs_tol=1e-9) and abs(effects["B"]["effect"]) < 1e-9
    assert effects["A"]["ci_low"] > 0.85 and effects["A"]["p_value"] is None and out.inference_capability == "ESTIMATION_ONLY"
    assert [x["family"] for x in out.composition] == ["A", "B"] and out.composition[0]["n_with_family"] == 84
    assert out.two_part[0]["n_q"] == 84 and out.emitted_order == ["health", "composition", "effects", "two_part_effects"]
    assert json.loads((tmp_path / "guard_outcomes.json").read_text())[0]["guard_id"] == "single_scale"
    sinks.write_effects(tmp_path / "e.tsv", out)
    rows = sinks.read_tsv(tmp_path / "e.tsv")
    assert rows[0]["p_value"] == "NA" and rows[0]["substrate_id"] == SUB and list(rows[0]) == list(sinks.EFFECTS)
    text = sinks.report_text(out.to_dict(), guards=("PRESENT", log.held))
    assert text.count("\n## ") == 12 and "single_scale" in text
    assert json.loads(sinks.put_json(tmp_path / "interpretation.json", out.to_dict()).read_text())["claim_scope"] == "EXTERNAL_STRUCTURE"
    wild = reading.interpret(hits, reading.Query("q", q, c, "base", "EXTERNAL"), LOW, n_bootstrap=100, estimator="bca-wild")
    by = {e["family_id"]: e for e in wild.effects}
    assert by["A"]["p_value"] < 0.05 < by["B"]["p_value"] and by["A"]["q_value"] >= by["A"]["p_value"]


def test_order_and_licenses_of_a_reading(spark):
    hits, (q, c) = hits_of(spark, planted(6)), sides(spark, 6)
    ask = lambda floors=reading.Floors(0.9, 3, 0.5), n=50, **k: reading.interpret(hits, reading.Query("q", **{"regions": q, "comparator": c, "comparator_id": "base", "provenance": "EXTERNAL", **k}), floors, n_bootstrap=n)
    held_back = ask(reading.Floors())
    assert held_back.suppression.startswith("reading suppressed: query: n_blocks=3") and held_back.composition is None and held_back.emitted_order == ["health"]
    side = ask(comparator=c.limit(1))
    assert side.suppression.startswith("effects suppressed: comparator") and side.composition and side.effects is None
    only = ask(provenance="EYEBALLED")
    assert only.effects is None and only.composition and only.output_mode == "DESCRIPTIVE_ONLY"
    assert ask(provenance="never heard of").output_mode == "DESCRIPTIVE_ONLY_UNVERIFIABLE_CONDITIONING"
    assert ask(features=["hit_coefficient"]).claim_scope == "SUBSTRATE_CIRCULAR"
    half = ask(provenance="CLUSTERED_WITH_SPLIT", held_out=q.unionAll(c))
    assert half.effects and "held-out" in half.notes[-1]
    for bad, what in (
        ({"comparator_id": "NA"}, "comparator"), ({"comparator": q}, "both sides"), ({"provenance": "CLUSTERED_WITH_SPLIT"}, "held-out"), ({"provenance": "CLUSTERED_WITH_SPLIT", "held_out": q}, "comparator"),
        ({"provenance": "PROGRAMMATIC_RULE"}, "written down"), ({"regions": q.limit(0)}, "denominator"), ({"n": 38}, "38"),
    ):
        with pytest.raises(Refusal, match=what):
            ask(**bad)
    with pytest.raises(Refusal, match="estimator"):
        reading.interpret(hits, reading.Query("q", q), estimator="other")
    for row, what in ((("r0_0", "chr9", 0, 50, "v", "A", 1.0, "used", 168, "L", SUB), "disagree"), (("r0_0", "chr1", 0, 50, None, None, None, "not_searched", 168, "L", SUB), "searched in one")):
        with pytest.raises(Refusal, match=what):
            reading.universe(hits_of(spark, [*planted(2), row]))


def test_every_spelling_of_absence(spark, tmp_path):
    from assaygrid.sources.readers import BLANK

    head = "\t".join(f.name for f in HIT)
    lines = [f"r{i}\tc\t1\t2\t{b}\t{b}\t{'' if b == '' else 'NA'}\tno_sequence_match\t1\tL\ts" for i, b in enumerate(BLANK)]
    (tmp_path / "h.tsv").write_text("\n".join([head, *lines]) + "\n")
    spark.createDataFrame([(f"r{i}", "c", 1, 2, b, b, float("nan"), "no_sequence_match", 1, "L", "s") for i, b in enumerate(BLANK)], HIT).write.parquet(str(tmp_path / "h.parquet"))
    one, two = (sorted(read_hits(spark, str(tmp_path / f"h.{x}")).collect()) for x in ("tsv", "parquet"))
    assert one == two and all(r.family_id is None and r.hit_coefficient is None for r in one)


def test_each_guard_passes_and_fails(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    hit = "input_scale long, substrate_id string, missingness string, hit_coefficient double"
    good = df([(1, "s", "used", 0.5), (1, "s", "not_searched", None)], hit)
    cases = [
        (guards.single_scale(good), guards.single_scale(df([(1, "s", "used", 0.5), (2, "s", "used", 1.0)], hit))),
        (guards.single_scale(good), guards.single_scale(good.limit(0))),
        (guards.single_scale(good), guards.single_scale(df([(None, "s", "used", 0.5)], hit))),
        (guards.four_state_missingness(good, {"total": 2, "defined": 1, "coverage": 0.5}), guards.four_state_missingness(good, {"defined": 2})),
        (guards.four_state_missingness(good, {}), guards.four_state_missingness(df([(1, "s", "hit_below_floor", 0.0)], hit), {})),
        (guards.no_key_parsing("x = variant_id"), guards.no_key_parsing("x = n.variant_id.split('_')[0]")),
        (guards.health_before_effect({"health": dict.fromkeys(guards.HEALTH, 1), "emitted_order": ["health"]}), guards.health_before_effect({"health": dict.fromkeys(guards.HEALTH, 1), "emitted_order": ["health"], "floor_failures": ["x"], "effects": [1]})),
        (guards.health_before_effect({"health": dict.fromkeys(guards.HEALTH), "floor_failures": ["x"], "emitted_order": ["health"]}), guards.health_before_effect({"health": dict.fromkeys(guards.HEALTH), "emitted_order": ["health"]})),
    ]
    two = lambda f, schema, ok, bad, **k: cases.append((f(df(ok, schema), **k), f(df(bad, schema), **k)))
    two(guards.variant_id_unique, "variant_id string, denovo_pattern_id string", [("a", "p"), ("b", "q")], [("a", "p"), ("a", "q")])
    two(guards.no_cross_model_cwm_avg, "id string, op string, group_by array<string>", [("a", "mean", list(guards.AXES)), ("b", "copy", None)], [("a", "mean", ["model"])])
    two(guards.sign_alignment, "registered_on string", [("unsigned_ppm",)], [("signed_cwm",)])
    two(guards.interaction_required, "id string, is_specificity_claim boolean, ci_low double, ci_high double", [("a", True, 0.1, 0.2), ("b", False, None, None)], [("a", True, -0.1, 0.2)])
    two(guards.estimability_floor, "id string, n long, ci_low double, ci_high double, reference double, status string", [("a", 30, None, None, None, "x"), ("b", 29, None, None, None, guards.UNDERPOWERED)], [("a", 29, None, None, None, "x")])
    two(guards.estimability_floor, "id string, n long, ci_low double, ci_high double, reference double, status string", [("a", 40, 0.1, 0.3, 0.2, "x")], [("a", 40, -0.1, 0.3, 0.2, "x")])
    two(guards.stratum_parity, "variable string, rule string", [("v", "r"), ("w", "s")], [("v", "r"), ("v", "s")])
    node = "variant_id string, core_length string, tomtom_q double, seqlet_count long, low_confidence_annotation boolean"
    two(guards.short_motif_flag, node, [("a", "7", 0.01, 100, False), ("b", "6", None, None, True), ("c", None, None, None, False)], [("a", "6", None, None, False)])
    two(guards.short_motif_flag, node, [("a", "7", 0.05, None, None)], [("a", "NA", None, None, True)])
    two(guards.single_family_layer, "id string, families array<string>, within_peak_share double, status string", [("a", ["x"], None, "NOT_ESTIMABLE"), ("b", ["x", "y"], 0.4, "OK")], [("a", ["x"], 1.0, "NOT_ESTIMABLE")])
    two(guards.selection_provenance_declared, "query_id string, selection_provenance string, output_mode string", [("a", "EXTERNAL", "FULL_INFERENCE"), ("b", None, guards.STRICTEST)], [("a", None, "FULL_INFERENCE")])
    two(guards.comparator_declared, "id string, comparator_id string", [("a", "x"), ("a", "x")], [("a", "x"), ("a", "y")])
    two(guards.comparator_declared, "id string, comparator_id string", [("a", "x")], [("a", "NA")])
    names = df([(0, "a"), (1, "b")], "place int, name string")
    for bad in ([(0, "b"), (1, "a")], [(0, "a"), (1, "c")], [(0, "a"), (1, "a")], []):
        cases.append((guards.index_order_matches_loader(names, names), guards.index_order_matches_loader(names, df(bad, "place int, name string"))))
    specs = df([("c1", "e1"), ("c2", "e1"), ("c3", "e2")], "cell_id string, estimand_id string")
    for bad in (("g", "e1", ["c1", "c3"]), ("g", "e2", ["c1"]), ("g", "e1", ["c9"]), ("g", "e1", [])):
        s = "group_key string, estimand_id string, cell_ids array<string>"
        cases.append((guards.no_cross_estimand_pooling(df([("g", "e1", ["c1", "c2"])], s), specs), guards.no_cross_estimand_pooling(df([bad], s), specs)))
    assert all(a.passed for a, _ in cases), [a for a, _ in cases if not a.passed]
    assert not any(b.passed for _, b in cases), [b for _, b in cases if b.passed]
    assert {b.guard for _, b in cases} == set(guards.GUARDS)
    assert {v.guard for v in guards.run_guards({"hits": good, "source": "x", "counts": {}})} >= {"single_scale", "no_key_parsing", "four_state_missingness"}
    log = sinks.GuardLog("t")
    with pytest.raises(Refusal):
        guards.require([cases[0][0], cases[0][1]], log)
    assert [r["passed"] for r in log.held] == [True, False] and guards.verdicts(spark, [cases[0][1]]).first().passed is False


def test_identities(spark):
    assert identity.canonical({"b": -0.0, "a": [1, True, None]}) == b'{"a":[1,true,null],"b":0}'
    for bad in ({"a": float("nan")}, {"a": {1}}, {"a": "/root/x"}, {"a": "C:\\x"}, {1: 2}, [1], {"a": object()}):
        with pytest.raises(identity.IdentityError):
            identity.canonical(bad)
    assert identity.decision_id(["b", "a"], "R", "c", "1") == identity.decision_id(["a", "b"], "R", "c", "1") != identity.decision_id(["a", "b"], "R", "c", "2")
    row = spark.createDataFrame([('n"1', "s", "1", "m\t")], "n string, s string, v string, m string").select(identity.candidate_id(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "nsvm"))).first()[0]
    assert row == identity.named("annotation", {"matched_motif_id": "m\t", "node_id": 'n"1', "source": "s", "source_version": "1"})
    for t in (None, 0.0, 3.63e-07):
        assert identity.affected_tolerance(identity.affected_text(t)) == t
    for bad in ("x", identity.BY_DELTA + "-1.0", identity.BY_DELTA + "nan", None):
        with pytest.raises(identity.IdentityError):
            identity.affected_tolerance(bad)
    a = {"tag": "pos", "node_id": "n", "variant_id": "v", "matrices": {"ppm": [[1.0, 0, 0, 0]]}}
    one = identity.lexicon_hash([a], {"trim": 0.3})
    assert one != identity.lexicon_hash([a], {"trim": 0.4}) and one != identity.lexicon_hash([{**a, "matrices": {"ppm": [[0.5, 0, 0, 0]]}}], {"trim": 0.3}) and one == identity.lexicon_hash([dict(a)], {"trim": 0.3})
    assert identity.found({"a": [{"k": 1}, {"b": {"k": 2}}]}, "k") == [1, 2] and identity.cell_text("a\tb\nc") == "a b c" and identity.cell_text(None) == "NA" and identity.markdown_text("a|b") == "a\\|b"
    with pytest.raises(identity.IdentityError):
        identity.file_digest("/tmp")


def test_criteria(spark, tmp_path):
    text = """
schema_version: "2"
criteria:
  - criterion_id: TD
    version: "2"
    status: FROZEN_DECLARED_HEURISTIC
    relationship: TRUE_DUPLICATE
    required_evidence: [at_floor, overlap_frac_source, ppm_similarity]
    predicates:
      - {field: at_floor, operator: is_true}
      - {field: overlap_frac_source, operator: ge, value: 1.0, provenance: derived, basis: the top, derived_from: {evidence_domain: overlap_frac_source, endpoint: max}}
      - {field: ppm_similarity, operator: ge, value: 0.9, provenance: declared, basis: chosen}
    insufficient_evidence_action: deferred
    decision_if_matched: collapse
    declared_rationale: said why
  - criterion_id: FM
    version: "1"
    status: CRITERION_NOT_YET_DEFINED
    relationship: FRAGMENT_MATCH
    required_evidence: [ppm_similarity]
    insufficient_evidence_action: deferred
"""
    (tmp_path / "c.yaml").write_text(text)
    c = criteria.read_criteria(str(tmp_path / "c.yaml"))
    rows = spark.createDataFrame([(1, True, 1.0, 0.95), (2, False, 1.0, 0.95), (3, None, 1.0, 0.95), (4, True, 0.9, 0.95)], "i int, at_floor boolean, overlap_frac_source double, ppm_similarity double")
    got = {r.i: (r.o, r.r, r.a, r.f) for r in rows.select("i", c["TD"].outcome().alias("o"), c["TD"].rationale().alias("r"), c["TD"].admits({"overlap_frac_source"}).alias("a"), c["FM"].outcome().alias("f")).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["collapse", "refuse_merge", "deferred", "refuse_merge"]
    assert "missing evidence: at_floor" in got[3][1] and "not met: overlap_frac_source ge 1.0" in got[4][1] and "chosen, not derived: ppm_similarity ge 0.9" in got[1][1]
    assert [got[i][2] for i in (1, 4)] == [True, False] and got[1][3] == "deferred"
    for old, new in (("value: 1.0, provenance: derived", "value: 0.5, provenance: derived"), ("endpoint: max", "endpoint: sign_boundary"), ("operator: is_true", "operator: like"), ("provenance: declared, basis: chosen", "provenance: declared"), ("schema_version: \"2\"", "schema_version: \"3\""),
                     ("declared_rationale: said why", "other: 1"), ("insufficient_evidence_action: deferred\n    decision", "insufficient_evidence_action: collapse\n    decision"), (", provenance: declared, basis: chosen", ""), ("criterion_id: FM", "criterion_id: TD"), ("at_floor, overlap_frac_source", "overlap_frac_source")):
        assert old in text
        (tmp_path / "b.yaml").write_text(text.replace(old, new))
        with pytest.raises(Refusal):
            criteria.read_criteria(str(tmp_path / "b.yaml"))
    for bad in ({"operator": "ge", "value": 1}, {"operator": "eq"}, {"operator": "eq", "value": 1, "provenance": "declared", "basis": "x"}):
        with pytest.raises(Refusal):
            criteria.Predicate("merge_confidence", **bad)
    p = spark.createDataFrame([(0.05, 19), (0.1, 19), (None, 19), (0.05, 0)], "empirical_p_value double, null_shuffles long").select(criteria.at_null_floor().alias("x")).collect()
    assert [r.x for r in p] == [True, False, None, None]


def change(spark, rows):
    return spark.createDataFrame(rows, "peak_id string, hit_id string, coefficient double, reconstruction double")


@pytest.mark.parametrize("n", [29, 30])
def test_stability(spark, n):
    before = [(f"p{i}", h, 1.0 + 0.1 * (i % 7), 1.0) for i in range(200) for h in "ab"]
    after = [("p%d" % i, "c" if i < n and h == "b" else h, x + 1e-9, 1.0 + (0.5 if i < n else 0)) for i in range(200) for h, x in (("a", 1.0 + 0.1 * (i % 7)), ("b", 1.0 + 0.1 * (i % 7)))]
    out = validation.stability("d", change(spark, before), change(spark, after))
    assert (out["n_affected_peaks"], out["n_affected_hits"], out["status"]) == (n, 3 * n, "LOW_RISK_RARE_NOT_VALIDATED" if n < 30 else "CHANGED_AFFECTED_SUBSET")
    assert math.isclose(out["hit_jaccard"], 1 / 3) and math.isclose(out["coefficient_conservation"], 1, abs_tol=1e-6) and out["paired_delta_reconstruction_all"] == 0 and math.isclose(out["paired_delta_reconstruction_affected"], 0.5)
    assert validation.stability("d", change(spark, before), change(spark, after), 0.0)["n_affected_peaks"] == 200
    b = change(spark, before)
    for rows, what in (([*before, before[0]], "twice"), ([*before[:-1], (*before[-1][:3], 2.0)], "two reconstructions"), ([*before[1:], ("p0", "a", float("nan"), 1.0)], "finite"), ([*before, (" ", "a", 1.0, 1.0)], "name"), ([], "no rows"), (before[:-2], "other peaks")):
        with pytest.raises(Refusal, match=what):
            validation.stability("d", b, change(spark, rows))

    class Absent:
        name = "gone"

        def compare(self, lexicons, decision_id):
            raise RuntimeError("not installed")

    results, log = validation.validate([validation.FrozenTables(b, change(spark, after)), Absent()], None, ["d"])
    assert len(results) == 1 and [x["status"] for x in log] == ["VERIFIED", "UNVERIFIED"]


def test_splits_and_runs(spark):
    peaks = lambda *x: spark.createDataFrame([(p,) for p in x], "peak_id string")
    splits = spark.createDataFrame([("a", "DISCOVERY"), ("b", "ADJUDICATION"), ("c", "VALIDATION"), ("d", "INFERENCE")], "peak_id string, role string")
    validation.check_split(splits, peaks("a", "b"), peaks("c"))
    validation.check_split(splits, peaks("a", "d"), peaks("c", "d"), "EXPLORATORY")
    for d, v in ((peaks("a"), peaks("d")), (peaks("c"), peaks("c")), (peaks("x"), peaks("c"))):
        with pytest.raises(Refusal):
            validation.check_split(splits, d, v)
    folds = [(f, p, "evaluation" if i % 2 == f else "decision") for f in (0, 1) for i, p in enumerate("abcd")]
    assert validation.check_cross_fit(peaks(*"abcd"), spark.createDataFrame(folds, "fold_id int, peak_id string, side string")).count() == 2
    for bad in (folds[1:], [*folds, (1, "e", "decision")], [(0, p, "evaluation") for p in "abcd"]):
        with pytest.raises(Refusal):
            validation.check_cross_fit(peaks(*"abcd"), spark.createDataFrame(bad, "fold_id int, peak_id string, side string"))
    run = lambda rows: spark.createDataFrame(rows, "peak string, motif string, start long, strand string, coefficient double")
    a = run([("p", "m", i, "+", 1.0) for i in range(6)] + [("out", "m", 1, "+", 1.0)])
    b = run([("p", "m", i, "+", 1.0 + i * 0.1) for i in range(1, 7)])
    r = validation.compare_runs(a, b, spark.createDataFrame([("p",)], "peak string")).first()
    assert (r.dropped, r.gained, r.changed) == (1, 1, 5) and math.isclose(r.jaccard, 5 / 7) and math.isclose(r.upper_median, 0.3) and math.isclose(r.max_delta, 0.5)
    rungs = validation.ladder(spark.range(50).withColumnRenamed("id", "row_id"), [5, 10, 20]).groupBy("rung").count().collect()
    assert {x.rung: x["count"] for x in rungs} == {5: 5, 10: 5, 20: 10}
    with pytest.raises(Refusal):
        validation.stability_of(splits.selectExpr("peak_id AS decision_id"), spark.createDataFrame([("a", "s", 1)] * 2, "decision_id string, status string, n_affected_peaks int"))


def test_annotation_and_consensus(spark):
    nodes = spark.createDataFrame([("n1", 8, 200), ("n2", 6, 200), ("n3", 9, 20), ("n4", 9, 200), ("n5", 9, 200), ("n6", 9, 200)], "node_id string, core_length int, seqlet_count long")
    m = lambda rows: spark.createDataFrame(rows, "node_id string, source string, source_version string, matched_motif_id string, q double")
    found = [("n1", "tomtom", "1", "a", 0.2), ("n1", "tomtom", "1", "a", 0.01), ("n1", "db", "1", "b", None), ("n2", "db", "1", "a", None), ("n2", "db", "1", "c", None), ("n3", "db", "1", "zz", None), ("n4", "db", "1", "a", None), ("n5", "db", "1", "a", None), ("n5", "db", "1", "b", None), ("n5", "db", "1", "c", None)]
    rows, log = annotation.annotate(nodes, [annotation.Matches("db", m(found)), annotation.Matches("bad", m([("nope", "x", "1", "a", None)]), optional=True)], spark.createDataFrame([("none", 0.5)], "candidate_id string, occurrence_null double"))
    assert [x["status"] for x in log] == ["VERIFIED", "UNVERIFIED"] and rows.count() == 9
    low = {(r.node_id, r.matched_motif_id): r.low_confidence_annotation for r in rows.collect()}
    assert not low["n1", "a"] and low["n2", "a"] and low["n3", "zz"] and not low["n4", "a"]
    with pytest.raises(Refusal):
        annotation.annotate(nodes, [annotation.Matches("bad", m([("nope", "x", "1", "a", None)]))])
    vocabulary = spark.createDataFrame([("a", "F"), ("b", "F"), ("c", "G")], "matched_motif_id string, family_id string")
    rule = dict.fromkeys(("rule_id", "rule_version", "vocabulary_id", "vocabulary_version"), "1")
    got = {r.node_id: (r.state, r.family_id, r.assignment_id) for r in annotation.consensus(rows, vocabulary, nodes, rule).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"n1": ("UNANIMOUS", "F"), "n2": ("SPLIT", None), "n3": ("UNDECLARED", None), "n4": ("TOO_FEW", None), "n5": ("MAJORITY", "F"), "n6": ("NO_CANDIDATE", None)}
    assert got["n1"][2] == identity.family_assignment_id("n1", "1", "1", "1", "1")
    with pytest.raises(Refusal):
        annotation.consensus(rows, vocabulary.unionAll(vocabulary), nodes, rule)
    f = __import__("pyspark.sql.functions", fromlist=["col"])
    v = spark.createDataFrame([(None, "v"), ("NA", "v"), ("s", "v"), ("s", "NA"), (None, None)], "s string, v string").select(annotation.variant_assigned(f.col("s"), f.col("v")).alias("x")).collect()
    assert [r.x for r in v] == [True, False, True, False, False]
    table = spark.createDataFrame([("gene", "a", "A1")], "namespace string, ident string, value string")
    assert annotation.translate(spark.createDataFrame([("a",)], "g string"), table, "g", "gene").first().g == "A1"
    with pytest.raises(Refusal):
        annotation.translate(spark.createDataFrame([("b",)], "g string"), table, "g", "gene")
    mats = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]], 1, 2), ([[1.0]], 0, 5)], "mat array<array<double>>, core_start int, core_end int")
    r = mats.select(annotation.declared_core().alias("d"), annotation.four_wide().alias("w"), annotation.reverse_complement().alias("r"), annotation.core_length().alias("n")).collect()
    assert r[0].d == [[5.0, 6.0, 7.0, 8.0]] and r[0].r == [[8.0, 7.0, 6.0, 5.0], [4.0, 3.0, 2.0, 1.0]] and r[0].n == 1 and r[1].d is None and (r[0].w, r[1].w) == (True, False)
    p = spark.createDataFrame([("U", "x", "neg", "pattern_1"), ("U", "x", "pos", "pattern_2"), ("U", "x", "pos", "pattern_10"), ("V", "y", "pos", "pattern_0")], "union_id string, analysis string, metacluster string, pattern string")
    assert {(x.union_id, x.metacluster, x.pattern): x.variant_id for x in annotation.variant_counters(p).collect()} == {("U", "pos", "pattern_10"): "U_UNASSIGNED_00", ("U", "pos", "pattern_2"): "U_UNASSIGNED_01", ("U", "neg", "pattern_1"): "U_UNASSIGNED_02", ("V", "pos", "pattern_0"): "V_UNASSIGNED_00"}


def test_compiling(spark, tmp_path):
    schema = "node_id string, variant_id string, metacluster string, model string, readout string, discovery_tier string, analysis_tier string, tier_reason string"
    nodes = spark.createDataFrame([(f"n{i}", f"v{i}", "pos" if i % 2 else "neg", "m", "r", "core", "core", None) for i in range(6)], schema)
    over = "node_id string, discovery_tier string, analysis_tier string, tier_reason string"
    kept = compiling.apply_tiers(nodes, spark.createDataFrame([("n5", None, "expanded", "said"), ("n4", None, "excluded", "said")], over))
    assert {r.node_id: r.analysis_tier for r in kept.collect()} == {"n0": "core", "n1": "core", "n2": "core", "n3": "core", "n5": "expanded"}
    for bad in (("n5", None, "expanded", None), ("x", None, "core", "said"), ("n5", None, "odd", "said")):
        with pytest.raises(Refusal):
            compiling.apply_tiers(nodes, spark.createDataFrame([bad], over))
    d = "cluster_id string, decision string, representative string, members array<string>, merge_confidence string, family_ambiguity boolean, threshold_sensitive boolean"
    decisions = spark.createDataFrame([("k1", "collapse", "n0", ["n0", "n2"], "high", False, False), ("k2", "collapse", "n1", ["n1", "n3"], "moderate", True, False), ("k3", "refuse_merge", None, ["n1", "n5"], "high", False, False)], d)
    sets = {x: {r.node_id for r in compiling.members(kept, decisions, x).collect()} for x in compiling.LEXICONS}
    assert sets == {"core": {"n0", "n1"}, "expanded": {"n0", "n1", "n5"}, "sensitivity": {"n0", "n1", "n3", "n5"}}
    assert {r.cluster_id: r.t for r in decisions.select("cluster_id", compiling.triggers().alias("t")).collect()} == {"k1": [], "k2": ["merge_confidence_not_high", "family_ambiguity"], "k3": []}
    with pytest.raises(Refusal, match="representative"):
        compiling.members(kept, spark.createDataFrame([("k", "collapse", "n5", ["n5", "n1"], "high", False, False)], d), "core")
    core, wide = (compiling.loading_order(compiling.members(kept, decisions, x)) for x in ("core", "expanded"))
    c = {r.metacluster: r for r in compiling.compare_lexicons(core, wide).collect()}
    assert c["neg"].same_set and c["neg"].same_order and not c["pos"].same_set and c["pos"].only_other == 1 and c["pos"].first_difference == 1
    mat = lambda x: [[x, 0.0, 0.0, 1.0]]
    registry = spark.createDataFrame([(f"n{i}", mat(float(i))) for i in range(6)], "node_id string, mat array<array<double>>")
    emitted = spark.createDataFrame([("n0", mat(1.0)), ("n1", mat(1.0)), ("n5", mat(9.0))], "node_id string, mat array<array<double>>")
    ops = {r.id: (r.op, r.group_by) for r in compiling.operations(emitted, registry, decisions, nodes).collect()}
    assert ops == {"n0": ("mean", list(guards.AXES)), "n1": ("copy", list(guards.AXES)), "n5": ("other", list(guards.AXES))}
    mats = spark.createDataFrame([(f"n{i}", "ppm", mat(float(i))) for i in range(6)], "node_id string, kind string, mat array<array<double>>")
    done = {x: compiling.compiled(compiling.loading_order(compiling.members(kept, decisions, x)), mats, {"trim_threshold": 0.3}) for x in compiling.LEXICONS}
    assert [m["node_id"] for m in done["expanded"]["members"]] == ["n1", "n5", "n0"]
    sinks.write_lexicon(tmp_path / "lex", done, [{"op": "copy"}])
    assert manifests.read_lexicons(tmp_path / "lex")["core"]["n_motifs"] == 2
    with pytest.raises(Refusal, match="there already"):
        sinks.write_lexicon(tmp_path / "lex", done, [])
    (tmp_path / "lex" / "stray").write_text("x")
    with pytest.raises(Refusal, match="no tier"):
        manifests.read_lexicons(tmp_path / "lex")
    (tmp_path / "lex" / "core.members.json").write_text("[]")
    with pytest.raises(Refusal):
        manifests.read_lexicon(tmp_path / "lex", "core")
    with pytest.raises(Refusal):
        compiling.one_length(spark.createDataFrame([("a", mat(1.0)), ("b", mat(1.0) * 2)], "node_id string, mat array<array<double>>"))


def test_manifests(spark, tmp_path):
    put = lambda name, tree: str(sinks.put_json(tmp_path / name, tree))
    caller = {"name": "c", "batch": 2}
    sid = identity.substrate_id(SUB, 3, caller)
    good = {"schema_version": "1", "substrate_id": sid, "peak_universe_hash": SUB, "n_regions": 3, "caller_specification": caller}
    sub = manifests.read_substrate(put("s.json", good))
    for bad in ({**good, "n_regions": 4}, {**good, "more": 1}, {k: v for k, v in good.items() if k != "n_regions"}):
        with pytest.raises(Refusal):
            manifests.read_substrate(put("b.json", bad))
    ledger = {"schema_version": "1", "substrate_id": sid, "n_opportunities": 4, "n_searched": 3, "n_retained": 2}
    rows = [(f"r{i}", "c", 1, 2, "v", "f", 0.5 if s == "used" else None, s, 1, "L", sid) for i, s in ((0, "used"), (0, "used"), (1, "hit_below_floor"), (2, "not_searched"))]
    manifests.check_against(hits_of(spark, rows), sub, manifests.read_ledger(put("l.json", ledger), sid))
    with pytest.raises(Refusal):
        manifests.check_against(hits_of(spark, rows[1:]), sub, ledger)
    with pytest.raises(Refusal):
        manifests.read_ledger(put("l.json", {**ledger, "n_retained": 9}))
    roles = {"a": "DISCOVERY", "b": "INFERENCE"}
    assert manifests.read_splits(spark, put("p.json", {"schema_version": "1", "assignments": roles, "checksum": identity.digest({"assignments": roles})})).count() == 2
    with pytest.raises(Refusal):
        manifests.read_splits(spark, put("p.json", {"schema_version": "1", "assignments": roles, "checksum": SUB}))
    art = validation.artifact("decision_split", {"peaks": ["a"]})
    assert manifests.read_artifact(put("a.json", art), "decision_split")["peaks"] == ["a"]
    with pytest.raises(Refusal):
        manifests.read_artifact(put("a.json", {**art, "peaks": ["b"]}), "decision_split")
    a = {"id": "x", "model": "m", "readout": "r", "union_id": "U1", "context": "c", "modisco_h5": "f"}
    project = manifests.read_project(put("j.json", {"analyses": [a, {**a, "id": "y"}]}))
    assert manifests.cross_model_restricted(project) and manifests.attribution_sources(["x", "y", "z"], {"g": ["x", "y"]}) == 2 and manifests.attribution_sources(["x"], None) is None
    for bad in ({"analyses": []}, {"analyses": [{**a, "union_id": "a b"}]}, {"analyses": [{**a, "model": ""}]}):
        with pytest.raises(Refusal):
            manifests.read_project(put("j.json", bad))
    assert [manifests.metacluster_state(*x) for x in ((False, True, 1), (True, False, 0), (True, True, 0), (True, True, 3))] == ["NOT_SEARCHED", "GROUP_ABSENT", "GROUP_EMPTY", "PRESENT"]
    assert [manifests.seqlet_count(x) for x in ({}, {"seqlets": {"n_seqlets": 4}}, {"seqlets": {"start": [1, 2]}})] == [None, 4, 2]
    with pytest.raises(Refusal):
        manifests.check_layout([manifests.OLD_LAYOUT], "x")
    with pytest.raises(Refusal, match="h5py|HDF5"):
        manifests.read_patterns("/none.h5", "x")
    m = put("m.json", {"tomtom": {"version": "5", "matches": [{"node_id": "n", "matched_motif_id": "a", "q": 0.1}]}, "homer": {"error": "no file"}, "db": {"matches": []}})
    assert manifests.read_matches(spark, m, "tomtom").first().q == 0.1
    for section in ("homer", "db", "other"):
        with pytest.raises(Refusal):
            manifests.read_matches(spark, m, section)
    assert manifests.read_occurrence_null(spark, put("o.json", {"c": 0.5})).first().occurrence_null == 0.5
    ds = [{"cluster_id": "k", "decision": "collapse", "representative": "a", "members": ["a", "b"]}]
    assert manifests.read_decisions(spark, put("d.json", {"artifact_id": identity.digest({"decisions": ds}), "decisions": ds})).count() == 1
    with pytest.raises(Refusal):
        manifests.read_decisions(spark, put("d.json", {"artifact_id": SUB, "decisions": ds}))
    assert manifests.read_record(tmp_path / "none")[0] == "ABSENT" and manifests.read_record(m)[0] == "PRESENT"
    (tmp_path / "bad.json").write_text("{")
    assert manifests.read_record(tmp_path / "bad.json")[0] == "UNREADABLE"
    (tmp_path / "t.tsv").write_text("axis\tsays\nA1\tx\nA2\ty\n")
    assert len(manifests.read_bias_ledger(tmp_path / "t.tsv", ["A1", "A2"], ["axis", "says"])) == 2
    with pytest.raises(Refusal):
        manifests.read_bias_ledger(tmp_path / "t.tsv", ["A1"], ["axis", "says"])
    (tmp_path / "h.tsv").write_text("peak\tmotif\tstart\tstrand\tcoefficient\np\tm\t1\t+\t0.5\np\tm\t1\t+\t0.6\n")
    with pytest.raises(Refusal, match="twice"):
        manifests.read_caller_hits(spark, str(tmp_path / "h.tsv"))
    change(spark, [("p", "h", 1.0, 2.0)]).write.parquet(str(tmp_path / "c.parquet"))
    assert manifests.read_change_table(spark, str(tmp_path / "c.parquet")).count() == 1


def test_tables_written_and_read(spark, tmp_path):
    f = __import__("pyspark.sql.functions", fromlist=["col"])
    edges = spark.createDataFrame([("b", "c"), ("a", "b")], "source_node_id string, target_node_id string").withColumns({c: f.lit(None).cast(t) for c, t in list(sinks.EDGES.items())[2:]})
    sinks.write_edges(edges, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert [t for _, t in back.dtypes] == [t.replace("long", "bigint") for t in sinks.EDGES.values()] and back.count() == 2
    sinks.write_edges(edges.limit(0), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).columns == list(sinks.EDGES)
    sinks.write_table(spark.createDataFrame([("a\tb", None)], "x string, y double"), str(tmp_path / "t"), ("x", "y"), ("x",))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().asDict() == {"x": "a b", "y": "NA"}
    nodes = spark.createDataFrame([("n1", "m")], "node_id string, model string")
    sinks.write_registry(str(tmp_path / "reg"), {"made": "here"}, nodes, spark.createDataFrame([("n1", "ppm", [[1.0, 0.0, 0.0, 0.0]])], "node_id string, kind string, mat array<array<double>>"))
    meta, n, mats = manifests.read_registry(spark, str(tmp_path / "reg"))
    assert meta["made"] == "here" and n.first().model == "m" and mats.first().kind == "ppm"
    sinks.write_annotation(str(tmp_path / "ann"), nodes, [{"backend": "x"}])
    assert manifests.read_versioned(spark, str(tmp_path / "ann" / "annotation_candidates.parquet"), "node_id string, model string").count() == 1
    with pytest.raises(Refusal):
        manifests.read_versioned(spark, str(tmp_path / "ann" / "annotation_candidates.parquet"), "node_id string, more string")
    d = spark.createDataFrame([("k", "deferred", None, ["a", "b"])], "cluster_id string, decision string, representative string, members array<string>")
    assert sinks.write_decisions(str(tmp_path / "dec"), d, {"by": "me"}) and manifests.read_decisions(spark, tmp_path / "dec" / "merge_decisions.json").first().members == ["a", "b"]
    assert "deferred" in (tmp_path / "dec" / "review.yaml").read_text()
    sinks.write_stability(tmp_path / "st", [{"a": 1}], {"b": "VERIFIED"})
    with pytest.raises(Refusal):
        sinks.write_stability(tmp_path / "st", [], {})
    for i in range(2):
        p = sinks.Provenance("s", tmp_path, ["cmd"], i)
        p.add_input("x", tmp_path / "st" / "stability_results.json")
        p.write()
    assert [x["seed"] for x in json.loads((tmp_path / "provenance.json").read_text())] == [0, 1]
    (tmp_path / "guard_outcomes.json").write_text("{broken")
    sinks.GuardLog("s", tmp_path).record(guards.Verdict("g", True, "d"), "x")
    assert len(json.loads((tmp_path / "guard_outcomes.json").read_text())) == 1 and list(tmp_path.glob("guard_outcomes.json.unreadable-*"))
    first = json.loads(sinks.write_status(tmp_path, "RUNNING", ["c"]).read_text())
    last = json.loads(sinks.write_status(tmp_path, "REFUSED", ["c"], exit_code=4).read_text())
    assert last["started"] == first["started"] and last["ended"] and last["exit_code"] == 4
    assert sinks.guards_of_run([{"provenance_records": 1}, {"provenance_records": 2}], 2)[0] == [{"provenance_records": 2}]


def test_design(spark, tmp_path):
    rows = planted(8) + [("r0_0", "chr1", 0, 50, "vC", "C", None, "hit_below_floor", 168, "L", SUB), ("u1", "chr2", 5, 9, "vD", "D", None, "not_searched", 168, "L", SUB)]
    hits_of(spark, rows).write.parquet(str(tmp_path / "hits.parquet"))
    hits_of(spark, [r for r in rows if r[5] != "B"]).write.parquet(str(tmp_path / "less.parquet"))
    for name, odd in (("q", 0), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"r{b}_{r}" for b in range(8) if b % 2 == odd for r in range(4)) + "\n")
    e = {"query_id": "q", "query_regions": "q.txt", "baseline_id": "c", "baseline_population_type": "rest", "baseline_construction_rule": "odd", "baseline_regions": "c.txt", "selection_provenance": "EXTERNAL", "selection_rule": "even"}
    m = {"measurement_id": "m1", "lexicon_id": "L", "substrate_id": SUB, "hit_table": "hits.parquet", "lexicon_content_hash": "h"}
    plan = {"estimands": [e, {**e, "query_id": "turned", "query_regions": "c.txt", "baseline_regions": "q.txt", "baseline_id": "q"}], "measurements": [m, {**m, "measurement_id": "m2", "hit_table": "less.parquet"}, {**m, "measurement_id": "m3", "lexicon_id": "other"}], "statistical_choices": [{"statistical_id": "s1", "n_bootstrap": 40, "floor_blocks": 4}, {"statistical_id": "s2", "n_bootstrap": 40}]}
    (tmp_path / "d.json").write_text(json.dumps(plan))
    outcomes, summaries = design.run_design(spark, tmp_path / "d.json", tmp_path / "out")
    assert design.histogram(outcomes) == {"SUCCESS": 4, "REFUSED_GUARD": 0, "REFUSED_SCHEMA": 4, "NOT_ESTIMABLE": 4, "ERROR": 0}
    states = {(o["cell_id"], o["family_id"]): o["status"] for o in design.family_states(outcomes)}
    ok = [o.cell for o in outcomes if o.status == "SUCCESS"]
    assert len(states) == 12 * 4 and set(states.values()) == {"ESTIMATED", "MEASURED_ZERO", "NOT_IN_LEXICON", "NOT_SEARCHED", "NOT_ESTIMABLE", "CELL_REFUSED"} - ({"MEASURED_ZERO"} if "MEASURED_ZERO" not in states.values() else set())
    assert {states[c.cell_id, "D"] for c in ok} == {"NOT_SEARCHED"} and {states[c.cell_id, "C"] for c in ok} == {"NOT_ESTIMABLE"} and {states[c.cell_id, "B"] for c in ok if c.measurement.measurement_id == "m2"} == {"NOT_IN_LEXICON"}
    a = {r.estimand_id: r for r in summaries.filter("family_id = 'A'").collect()}
    assert len(a) == 2 and all(r.n_cells == 2 and r.sign_agreement == "2/2 share a sign" for r in a.values())
    text = (tmp_path / "out" / "specification_curve.md").read_text()
    assert text.count("2/2 share a sign") >= 2 and "No cell" not in text
    assert {p.name for p in (tmp_path / "out").glob("*.tsv")} == {"cells.tsv", "dropped_cells.tsv", "family_effects.tsv", "family_cells.tsv", "stability_by_estimand.tsv", "cell_guard_outcomes.tsv"}
    one = [c.cell_id for c in design.specifications(str(tmp_path), *design.read_design(tmp_path / "d.json")[1:])]
    (tmp_path / "q.txt").write_text("r0_0\n")
    assert set(one) & {c.cell_id for c in design.specifications(str(tmp_path), *design.read_design(tmp_path / "d.json")[1:])} == set() and len(set(one)) == 12
    for bad in ({**plan, "estimands": [{**e, "more": 1}]}, {**plan, "measurements": []}, {**plan, "statistical_choices": [{}]}):
        (tmp_path / "b.json").write_text(json.dumps(bad))
        with pytest.raises(Refusal):
            design.read_design(tmp_path / "b.json")


def test_bca_of_any_statistic(spark):
    rows = [("A", b, [1.0 + 0.1 * (b % 3)], [0.1 * (b % 5)]) for b in range(40)] + [("few", b, [1.0], [0.0]) for b in range(29)]
    df = spark.createDataFrame(rows, "family string, block int, q array<double>, c array<double>")
    got = {r.family: r for r in bca_of(df, lambda a, b: sum(a) / len(a) - sum(b) / len(b), 200).collect()}
    assert got["A"].ci_low < got["A"].estimate < got["A"].ci_high and got["few"].estimate == 1.0 and got["few"].ci_low is None


def test_command_line(spark, tmp_path):
    """Every stage that needs no HDF5, end to end; a refusal exits with 4 and says so in the status."""
    import random

    from assaygrid.cli import main

    run = lambda *a: main(list(map(str, a)), spark)
    status = lambda d: json.loads((tmp_path / d / "run_status.json").read_text())
    hits_of(spark, planted(64)).write.parquet(str(tmp_path / "h.parquet"))
    for name, odd in (("q", 0), ("c", 1)):
        (tmp_path / f"{name}.bed").write_text("".join(f"chr1\t1\t2\tr{b}_{r}\n" for b in range(64) if b % 2 == odd for r in range(4)))
    ask = ("--peaks", tmp_path / "q.bed", "--comparator", tmp_path / "c.bed", "--comparator-id", "c", "--selection-provenance", "EXTERNAL", "--bootstrap", 60)
    assert run("interpret", tmp_path / "h.parquet", *ask, "--out", tmp_path / "i") == 0 and status("i")["status"] == "COMPLETED"
    assert run("infer", tmp_path / "h.parquet", *ask, "--out", tmp_path / "e") == 0
    assert {r["family_id"] for r in sinks.read_tsv(tmp_path / "e" / "effect_estimates.tsv")} == {"A", "B"}
    assert run("infer", tmp_path / "h.parquet", *ask[:-4], "--selection-provenance", "EYEBALLED", "--out", tmp_path / "r") == 4 and status("r")["status"] == "REFUSED"
    assert run("report", tmp_path / "i" / "interpretation.json", "--out", tmp_path / "rep") == 0 and "Effects" in (tmp_path / "rep" / "report.md").read_text()
    assert run("report", tmp_path / "none.json", "--out", tmp_path / "rep2") == 4
    rng = random.Random(1)
    names = [f"n{i}" for i in range(5)]
    mats = [(n, "cwm", [[rng.gauss(0, 1) for _ in range(4)] for _ in range(10)]) for n in names[:4]]
    schema = "node_id string, variant_id string, metacluster string, discovery_tier string, analysis_tier string, seqlet_count long, core_start int, core_end int"
    nodes = spark.createDataFrame([(n, f"v{n}", "pos", "core", "core", 200, 0, 10) for n in names], schema)
    cut = nodes.withColumn("core_start", __import__("pyspark.sql.functions", fromlist=["when"]).expr("CASE node_id WHEN 'n1' THEN 2 WHEN 'n2' THEN 6 WHEN 'n3' THEN NULL ELSE 0 END"))
    sinks.write_registry(str(tmp_path / "cut"), {}, cut, spark.createDataFrame(mats, "node_id string, kind string, mat array<array<double>>"))
    assert run("align", tmp_path / "cut", "--null-shuffles", 2, "--out", tmp_path / "alc") == 0
    e = spark.read.parquet(str(tmp_path / "alc" / "alignment_edges.parquet")).collect()
    assert [(r.source_node_id, r.target_node_id) for r in e] == [("n0", "n1")] and e[0].overlap_bp <= 8 and "n0 n1" in status("alc")["said"]  # cores of 10, 8 and 4 rows, and none
    left = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "alc" / "alignment_excluded_pairs.tsv")).collect()
    assert {(r.source_node_id, r.target_node_id): r.exclusion_reason for r in left if r.target_node_id == "n2"} == dict.fromkeys([("n0", "n2"), ("n1", "n2")], "no_offset_meets_overlap_floor")
    assert {r.target_node_id: r.target_node_status for r in left if r.source_node_id == "n0"} == {"n2": "registrable", "n3": "no_declared_trimmed_core", "n4": "no_ppm_array"}
    sinks.write_registry(str(tmp_path / "reg"), {}, nodes, spark.createDataFrame(mats, "node_id string, kind string, mat array<array<double>>"))
    assert run("align", tmp_path / "reg", "--null-shuffles", 3, "--out", tmp_path / "al") == 0
    summary = json.loads((tmp_path / "al" / "alignment_run_summary.json").read_text())
    assert (summary["n_pairs_considered"], summary["n_edges"], summary["n_pairs_excluded_by_reason"]["node_not_registrable"]) == (10, 6, 4)
    left = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "al" / "alignment_excluded_pairs.tsv")).collect()
    assert sorted((r.source_node_id, r.target_node_id, r.exclusion_reason, r.target_node_status) for r in left) == [(f"n{i}", "n4", "node_not_registrable", "no_ppm_array") for i in range(4)]
    assert run("align", tmp_path / "reg", "--null-shuffles", 0, "--out", tmp_path / "al0") == 4 and run("align", tmp_path / "reg", "--null-shuffles", 3, "--out", tmp_path / "al") == 4
    (tmp_path / "m.json").write_text(json.dumps({"tomtom": {"version": "1", "matches": [{"node_id": "n0", "matched_motif_id": "a", "q": 0.01}]}}))
    assert run("annotate", tmp_path / "m.json", "--registry", tmp_path / "reg", "--section", "tomtom", "--section", "homer", "--out", tmp_path / "an") == 0
    assert [b["status"] for b in json.loads((tmp_path / "an" / "annotation_backends.json").read_text())] == ["VERIFIED", "UNVERIFIED"]
    ds = [{"cluster_id": "k", "decision": "collapse", "representative": "n0", "members": ["n0", "n1"], "merge_confidence": "high"}]
    sinks.put_json(tmp_path / "d.json", {"artifact_id": identity.digest({"decisions": ds}), "decisions": ds})
    assert run("compile", tmp_path / "reg", "--decisions", tmp_path / "d.json", "--out", tmp_path / "co") == 0
    assert manifests.read_lexicons(tmp_path / "co" / "lexicons")["core"]["n_motifs"] == 4
    assert [(o["id"], o["op"]) for o in json.loads((tmp_path / "co" / "lexicons" / "combination_operations.json").read_text())] == [("n0", "copy"), ("n2", "copy"), ("n3", "copy")]
    assert {"no_cross_model_cwm_avg", "index_order_matches_loader"} <= {g["guard_id"] for g in json.loads((tmp_path / "co" / "guard_outcomes.json").read_text())}
    (tmp_path / "ledger.tsv").write_text("axis_id\tbias\tmechanism\tcontrol\n" + "".join(f"BA-{i:02d}\tb\tm\tc\n" for i in range(1, 21)))
    assert run("report", tmp_path / "i" / "interpretation.json", "--bias-ledger", tmp_path / "ledger.tsv", "--out", tmp_path / "rep3") == 0
    (tmp_path / "ledger.tsv").write_text("axis_id\tbias\tmechanism\tcontrol\nBA-01\tb\tm\tc\n")
    assert run("report", tmp_path / "i" / "interpretation.json", "--bias-ledger", tmp_path / "ledger.tsv", "--out", tmp_path / "rep4") == 4
    rows = [(f"p{i}", h, 1.0, 1.0) for i in range(40) for h in "ab"]
    change(spark, rows).write.parquet(str(tmp_path / "b.parquet"))
    change(spark, [(p, "c" if h == "b" else h, x, y) for p, h, x, y in rows]).write.parquet(str(tmp_path / "a.parquet"))
    assert run("validate", tmp_path / "b.parquet", "--after", tmp_path / "a.parquet", "--decision-id", "d", "--out", tmp_path / "v") == 0
    assert run("validate", tmp_path / "b.parquet", "--after", tmp_path / "a.parquet", "--decision-id", "d", "--out", tmp_path / "v") == 4
    assert run("ingest", tmp_path / "m.json", "--out", tmp_path / "in") == 4
    assert run("multiverse", tmp_path / "m.json", "--out", tmp_path / "mu") == 4
    e = spark.createDataFrame([(1, 2, 1.0, 1.0, 9, 0.95, 0.5, 0.05)], "u long, v long, overlap_frac_source double, overlap_frac_target double, overlap_bp long, ppm_similarity double, signed_cwm_similarity double, empirical_p_value double")
    e.write.parquet(str(tmp_path / "edges.parquet"))
    spark.createDataFrame([(i, "F", None, 0.5, 10 + i, 1.0, 1) for i in (1, 2)], "node long, family string, variant string, completeness double, seqlets long, core_ic double, recurrence int").write.parquet(str(tmp_path / "motifs.parquet"))
    assert run("adjudicate", tmp_path / "edges.parquet", "--motifs", tmp_path / "motifs.parquet", "--out", tmp_path / "ad") == 0
    assert manifests.read_decisions(spark, tmp_path / "ad" / "merge_decisions.json").first().decision == "collapse"


def test_generator_and_progress(spark, tmp_path):
    import time

    from assaygrid.operators.registration import register
    from assaygrid.sources.generator import make_registry
    from assaygrid.sources.scratch import progress

    f = __import__("pyspark.sql.functions", fromlist=["col"])
    for name, seed in (("a", 1), ("b", 1), ("c", 2)):
        make_registry(spark, str(tmp_path / name), seed)
    read = {n: manifests.read_registry(spark, str(tmp_path / n)) for n in "abc"}
    mats = {n: sorted(r[2].collect()) for n, r in read.items()}
    assert mats["a"] == mats["b"] != mats["c"] and read["a"][1].groupBy("metacluster").count().count() == 2
    motifs = read["a"][2].filter("kind = 'cwm'").select(f.xxhash64("node_id").alias("node"), f.flatten("mat").alias("embedding"))
    assert register(motifs).filter("signed_cwm_similarity < 0").count() == 8  # 4 positive times 2 negative ones
    heard = []
    with progress(spark, lambda done, total: heard.append((done, total)), 0.05):
        spark.range(4).repartition(4).rdd.map(lambda x: time.sleep(0.5)).count()
    assert heard and max(t for _, t in heard) >= 4
