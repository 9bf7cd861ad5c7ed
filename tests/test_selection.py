"""Ranks and medians against sorting, on values that one outlier stretches and that one value fills."""

import random
import statistics

from pyspark.sql import functions as F

from assaygrid.operators.selection import counted, medians, ranked


def test_ranks_and_medians_of_skewed_values(spark):
    rng = random.Random(4)
    groups = {
        "stretched": [rng.random() for _ in range(2000)] + [1e300, -1e300],
        "one value": [0.25] * 3000 + [rng.random() for _ in range(501)],
        "tiny": [1e-300 * i for i in range(1001)],
        "even": [1.0, 2.0, 5.0, 9.0],
        "single": [3.0],
        None: [1.0, 1.0, 2.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("nothing", None)], "g string, v double").repartition(5)
    values = counted(df, F.col("g"), F.col("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.grp: (r.lower, r.upper, r.middle) for r in medians(values).collect()}
        ranks = {(r.grp, r.delta): (r.upto, r.total) for r in ranked(values).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {g: (statistics.median_low(v), statistics.median_high(v), statistics.median(v)) for g, v in groups.items()}
    assert ranks == {(g, x): (sum(y <= x for y in v), len(v)) for g, v in groups.items() for x in set(v)}
