"""Nulls of registrations: parts of the shuffles add up alike however they are cut; scores alone are those of full registrations."""

import numpy as np
from pyspark.sql import functions as F

from assaygrid.operators import registration


def motifs(n, rng):
    return [(rng.normal(size=4 * int(rng.integers(4, 14))) * rng.choice([1.0, 0.2], size=1)).tolist() for _ in range(n)]


def test_scores_alone_are_those_of_registrations():
    rng = np.random.default_rng(6)
    a, b = registration.cores(motifs(40, rng)), registration.cores([*motifs(30, rng), [0.0] * 32])
    for k in (None, 0, 5):
        c = b if k is None else b.shuffled(3, k)
        whole, alone = registration.best(a, c)[0], registration.best_score(a, c)
        assert (alone[whole > -2] == whole[whole > -2]).all() and (whole > -2).any() and (whole == -2).any()


def test_nulls_do_not_depend_on_how_shuffles_and_motifs_are_cut(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(list(enumerate(motifs(24, rng))), "node long, embedding array<double>")
    one = sorted(map(tuple, registration.null_summary(df, 13, at_once=13).collect()))
    assert one == sorted(map(tuple, registration.null_summary(df, 13, at_once=4, block=7).collect())) and one
    plain = {}
    tool = registration.cores([r.embedding for r in df.orderBy("node").collect()])
    seen = registration.best(tool, tool)[0]
    draws = [registration.best(tool, tool.shuffled(7, k))[0] for k in range(13)]
    for s, t, n, seed, p, mean, low, high in one:
        x = [d[s, t] for d in draws]
        plain[s, t] = ((sum(v >= seen[s, t] for v in x) + 1) / 14, round(sum(x) / 13, 9), min(x), max(x))
        assert np.allclose((p, mean, low, high), plain[s, t], atol=2e-9) and p == plain[s, t][0] and (n, seed) == (13, 7)


def test_blocks_meet_once_and_are_not_copied_for_the_pairs(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(list(enumerate(motifs(40, rng))), "node long, embedding array<double>")
    dealt, blocks = registration._dealt(df, 1)
    met = registration._met(dealt, blocks, 2)
    assert blocks == 40 and "CartesianProduct" in met._jdf.queryExecution().executedPlan().toString()
    found = sorted((min(r.b, r.o), max(r.b, r.o), r.part) for r in met.select("b", "o", "part").collect())
    assert found == [(i, j, p) for i in range(40) for j in range(i, 40) for p in range(2)]
    held = [r[0] for r in met.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert met.rdd.getNumPartitions() == len(held) and max(held) < 3 * min(held) + 4  # no task without a share


def test_workers_of_a_plan_use_one_thread(spark):
    import os

    from assaygrid.sources.scratch import one_thread

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [os.environ.get("OPENBLAS_NUM_THREADS")] * b.num_rows})

    held = dict(spark.sparkContext.environment)
    with one_thread(spark):
        df = spark.range(4).mapInArrow(run, "n string")
    assert {r.n for r in df.collect()} == {"1"} and spark.sparkContext.environment == held
