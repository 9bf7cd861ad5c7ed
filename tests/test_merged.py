"""Statistics of merged block states against loops over drawn blocks; backends of matches that stay distributed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.operators import annotation
from assaygrid.operators.intervals import LEAST, bca_limits, bca_merged, block_states, drawn
from assaygrid.sources.readers import Refusal


def test_merged_intervals_are_those_of_a_loop(spark):
    def init(q, c):
        return [sum(q), len(q), sum(c), len(c)]

    def finish(s):
        return None if s[1] <= 0 or s[3] <= 0 else s[0] / s[1] - s[2] / s[3]

    rng = random.Random(3)
    blocks = {f: [(f"b{i:03d}", [rng.gauss(m, 1) for _ in range(rng.randint(0, 4))], [rng.gauss(0, 1) for _ in range(rng.randint(0, 4))]) for i in range(n)] for f, m, n in (("a", 1.0, 45), ("b", 0.0, 60), ("few", 0.5, 12))}
    rows = [(f, *b) for f, bs in blocks.items() for b in bs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "family string, block string, q array<double>, c array<double>")
    runs = [sorted(map(tuple, bca_merged(block_states(df.repartition(k), init), finish, 80, 5).collect())) for k in (1, 4)]
    assert [r[:1] + r[4:] for r in runs[0]] == [r[:1] + r[4:] for r in runs[1]]
    for family, estimate, low, high, n_blocks, n_reps in runs[1]:
        states = np.array([init(q, c) for _, q, c in sorted(blocks[family])])
        whole, n = finish(states.sum(0)), len(states)
        reps = np.array([v for r in range(80) if (v := finish(drawn(5, r, n) @ states)) is not None])
        assert (n_blocks, n_reps) == (n, len(reps)) and np.isclose(estimate, whole)
        if n < LEAST:
            assert low is None and high is None
            continue
        left = np.array([finish(states.sum(0) - s) for s in states])
        d = left.mean() - left
        share = ((reps < whole).sum() + (reps <= whole).sum()) / (2 * len(reps))
        assert np.allclose((low, high), bca_limits(np.sort(reps), share, (d**3).sum() / (6 * (d**2).sum() ** 1.5)))
        other = next(r for r in runs[0] if r[0] == family)
        assert np.allclose((low, high), other[2:4])


def test_backends_that_stay_distributed(spark, tmp_path):
    """A million matches are read in partitions, their section's filter reaches the files; a tool runs in tasks."""
    n = 1_000_000
    big = spark.range(n).select(F.concat(F.lit("n"), (F.col("id") % 1000).cast("string")).alias("node_id"), F.when(F.col("id") % 2 == 0, "homer").otherwise("tomtom").alias("source"), F.lit("2").alias("source_version"), F.concat(F.lit("m"), (F.col("id") % 50000).cast("string")).alias("matched_motif_id"), (F.col("id") / n).alias("q"))
    big.repartition(8).write.parquet(str(tmp_path / "m"))
    nodes = spark.range(1000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.lit(9).alias("core_length"), F.lit(200).alias("seqlet_count"))
    own = annotation.Table("homer", str(tmp_path / "m"), "2")
    found = own.annotate(nodes)
    assert found.count() == n // 2 and found.rdd.getNumPartitions() > 1
    assert "PushedFilters: [IsNotNull(source), IsNotNull(source_version), EqualTo(source,homer), EqualTo(source_version,2)]" in found._jdf.queryExecution().toString()

    def match(pdf):
        return pdf.assign(matched_motif_id="x" + pdf.node_id, q=0.01)[pdf.node_id.str.endswith("7")]

    rows, log = annotation.annotate(nodes.repartition(3), [own, annotation.Tool("tool", "1", match), annotation.Table("none", str(tmp_path / "m"), "2", optional=True)])
    assert {r.source: r["count"] for r in rows.groupBy("source").count().collect()} == {"homer": 25000, "tool": 100}
    assert [b["status"] for b in log] == ["VERIFIED", "VERIFIED", "UNVERIFIED"]
    with pytest.raises(Refusal):
        annotation.annotate(nodes.limit(10), [own])
