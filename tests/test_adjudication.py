"""Components, criteria and overrides against hand-made cases."""

import pytest


def test_components(spark):
    from assaygrid.operators.graph import components

    chain = [(i, i + 1) for i in range(10, 60)]
    star = [(100, i) for i in range(101, 140)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (201, 200), (200, 201), (200, 201)], "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    want = {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components(df.limit(0)).count() == 0


def test_criteria(spark):
    from assaygrid.operators.adjudication import criterion, holds

    rule = (("s", "ge", 0.5), ("ok", "is_true", None))
    rows = [(0.5, True), (0.4, True), (0.9, False), (None, True), (0.1, None)]
    df = spark.createDataFrame(rows, "s double, ok boolean").selectExpr(f"{criterion(rule)} AS o")
    assert [r.o for r in df.collect()] == ["collapse", "refuse_merge", "refuse_merge", "deferred", "deferred"]
    assert criterion(rule, defined=False) == "'deferred'"
    assert holds(x for x in rule) == "(s >= 0.5) AND (ok)"
    for bad in (("s", "near", 1), ("s", "ge", None), ("ok", "is_true", 1)):
        with pytest.raises(ValueError):
            holds([bad])


def test_override(spark):
    from assaygrid.operators.adjudication import override

    df = spark.createDataFrame([(1, "deferred"), (2, "collapse")], "component long, decision string")
    once = override(df, 1, "collapse", "curator", "seen by eye")
    got = {r.component: (r.decision, r.automated_decision, r.operator) for r in override(once, 2, "refuse_merge", "curator", "no").collect()}
    assert got == {1: ("collapse", "deferred", "curator"), 2: ("refuse_merge", "collapse", "curator")}
    with pytest.raises(ValueError):
        override(df, 1, "collapse", " ", "x")


def test_admitted_pairs_are_fewer(spark):
    from assaygrid.plans.engine import QUERIES

    got = QUERIES["edge_admission"](spark, "/root/testdata/sf0.001").groupBy("admitted").count().collect()
    assert {r.admitted for r in got} == {True, False}
    kinds = {r.decision for r in QUERIES["component_adjudication"](spark, "/root/testdata/sf0.01").select("decision").distinct().collect()}
    assert kinds == {"collapse", "deferred", "refuse_merge"}


def test_both_passes_of_a_proposal(spark):
    """A chain is deferred as a whole; its tight pairs are proposed again, an equal cluster is not; each outcome occurs."""
    import json

    import pytest

    from assaygrid.operators.adjudication import adjudicate_all
    from assaygrid.sources.readers import Refusal

    schema = "u long, v long, overlap_frac_source double, overlap_frac_target double, overlap_bp long, ppm_similarity double, signed_cwm_similarity double, empirical_p_value double"
    good = (1.0, 1.0, 9, 0.95, 0.5, 0.05)
    rows = [(1, 2, *good), (2, 3, 1.0, 1.0, 9, 0.5, 0.5, 0.05), (10, 11, *good), (20, 21, *good[:4], -0.9, 0.05), (30, 31, 0.8, 1.0, 9, 0.95, 0.5, 0.05), (40, 41, *good)]
    motif = lambda i: (i, "G" if i == 41 else "F", None, 0.5, 10 + i, 1.0, 1)
    motifs = spark.createDataFrame([motif(i) for r in rows for i in r[:2]], "node long, family string, variant string, completeness double, seqlets long, core_ic double, recurrence int").distinct()
    out = adjudicate_all(spark.createDataFrame(rows, schema), motifs).collect()
    got = {(r["pass"], tuple(json.loads(r.members))): (r.decision, r.reason, r.medoid) for r in out}
    assert got["wide", ("1", "2", "3")][:2] == ("deferred", "unregistered_pairs") and got["tight", ("1", "2")] == ("collapse", "member_gates", 2)
    assert got["wide", ("10", "11")] == ("collapse", "member_gates", 11) and got["wide", ("20", "21")][0] == "refuse_merge"
    assert got["wide", ("30", "31")][:2] == ("deferred", "criterion_not_defined") and got["wide", ("40", "41")][:2] == ("refuse_merge", "criterion")
    assert len(got) == 6 and len({r.decision_id for r in out}) == 6
    for bad in ([*rows, (2, 1, *good)], [*rows, (1, 99, *good)]):
        with pytest.raises(Refusal):
            adjudicate_all(spark.createDataFrame(bad, schema), motifs)


def test_medoids_and_ties_merge_as_windows_tell_them(spark):
    """Random components with many equal and missing fields: greatest rows and ladders of counts against windows."""
    import random

    from assaygrid.plans.relations import CATALOGUE as C

    rng = random.Random(8)
    edges = [(a, b) for c in range(60) for k in [rng.randint(2, 7)] for a in range(c * 10, c * 10 + k) for b in range(a + 1, c * 10 + k)]
    rows = [(u, v, 1.0, 1.0, 9, rng.choice([0.9, 0.9, 0.95]), 0.5, 0.05) for u, v in edges]
    some = lambda *x: rng.choice([None, *x, *x, *x])
    motifs = [(n, "F", "v", some(0.5, 0.6), some(3, 4), some(1.0), some(1, 2)) for n in {x for e in edges for x in e}]
    held = {
        "edges": spark.createDataFrame(rows, "u long, v long, overlap_frac_source double, overlap_frac_target double, overlap_bp long, ppm_similarity double, signed_cwm_similarity double, empirical_p_value double"),
        "motif": spark.createDataFrame(motifs, "node long, family string, variant string, completeness double, seqlets long, core_ic double, recurrence int"),
    }
    got = sorted(map(tuple, C.over("medoid", held).select("component", "medoid", "similarity", "missing_field").collect()))
    want = sorted(map(tuple, C.over("plain_medoid", held).select("component", "medoid", "similarity", "missing_field").collect()))
    assert got == want and len(got) == 60 and len({r[3] for r in got}) > 3
