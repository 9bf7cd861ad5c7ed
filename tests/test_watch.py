"""Guards watched while a table is written: sound tables pass, each planted fault fails its guard and is named, in one job."""

import pytest

from assaygrid.operators import watch
from assaygrid.sources.scratch import written

HITS = "region_id string, missingness string, hit_coefficient double, input_scale long, substrate_id string"
CASES = [
    (watch.four_states, HITS, [("a", "used", 1.0, 1, "s"), ("b", "not_searched", None, 1, "s")], [("z", "used", None, 1, "s"), ("y", "hit_below_floor", 0.0, 1, "s"), ("x", "gone", None, 1, "s"), ("w", None, None, 1, "s")]),
    (watch.scale, HITS, [("a", "used", 1.0, 1, "s")] * 2, [("a", "used", 1.0, 2, "s"), ("a", "used", 1.0, 1, "t"), ("a", "used", 1.0, None, "s")]),
    (watch.means, "id string, op string, group_by array<string>", [("a", "mean", ["model", "readout", "metacluster"]), ("b", "copy", None)], [("z", "mean", ["model"]), ("z", "average", None)]),
    (watch.unsigned, "source_node_id string, registered_on string", [("a", "unsigned_ppm")], [("z", "signed_cwm"), ("z", None)]),
    (watch.interactions, "id string, is_specificity_claim boolean, ci_low double, ci_high double", [("a", True, 0.1, 0.2), ("b", False, None, None)], [("z", True, -0.1, 0.2), ("z", True, None, 0.2)]),
    (watch.estimable, "id string, n long, status string, ci_low double, ci_high double, reference double", [("a", 30, "OK", 0.1, 0.2, 0.0), ("b", 3, "NOT_ESTIMABLE_UNDERPOWERED", None, None, None)], [("z", 29, "OK", 0.1, 0.2, 0.0), ("z", None, "OK", 0.1, 0.2, 0.0), ("z", 50, "OK", -0.1, 0.2, 0.1)]),
    (watch.weak_flags, "node_id string, core_length int, source string, q double, seqlet_count long, low_confidence_annotation boolean", [("a", 6, "TomTom", 0.9, 5, True), ("b", 7, "homer", 0.9, 100, False), ("c", None, None, None, None, None)], [("z", 6, "homer", 0.0, 500, False), ("z", 9, "tomtom", 0.06, 500, None), ("z", 9, "homer", 0.0, 99, False)]),
    (watch.lone_families, "id string, families array<string>, within_peak_share double, status string", [("a", ["F", "G"], 0.5, "OK"), ("b", ["F", "F"], None, "NOT_ESTIMABLE")], [("z", ["F"], 1.0, "NOT_ESTIMABLE"), ("z", None, None, "OK")]),
    (watch.declared_modes, "query_id string, selection_provenance string, output_mode string", [("a", "EXTERNAL", "FULL_INFERENCE"), ("b", "odd", "DESCRIPTIVE_ONLY_UNVERIFIABLE_CONDITIONING")], [("z", "EYEBALLED", "FULL_INFERENCE"), ("z", None, None)]),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0].__name__)
def test_each_guard_passes_and_fails(spark, case):
    make, schema, fine, faults = case
    guard = make()
    for extra in [[], *[[f] for f in faults]]:
        w = watch.Watched(spark.createDataFrame([*fine, *extra], schema).repartition(3), guard)
        out = written(w.table, "watched")
        (v,) = w.verdicts()
        assert v.guard == guard.guard and v.passed == (not extra) and out.count() == len(fine) + len(extra)
        assert not extra or guard.guard == "single_scale" or extra[0][0] in v.detail


def test_many_guards_ride_on_one_scan(spark):
    """Two guards of one table, and no job but the write."""
    df = spark.createDataFrame([("a", "used", 1.0, 1, "s"), ("b", "used", None, 2, "s")], HITS)
    w = watch.Watched(df, watch.scale(), watch.four_states())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("watched", "")
    written(w.table, "watched")
    jobs = len(tracker.getJobIdsForGroup("watched"))
    got = w.verdicts()
    assert [(v.guard, v.passed) for v in got] == [("single_scale", False), ("four_state_missingness", False)] and len(tracker.getJobIdsForGroup("watched")) == jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
