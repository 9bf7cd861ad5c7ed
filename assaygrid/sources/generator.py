"""A registry of made-up motifs for trials: positive and negative patterns over flat background, the same for a seed."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession

from .sinks import write_registry

NODES = "node_id string, model string, readout string, context string, metacluster string, union_id string, variant_id string, variant_assignment_source string, denovo_pattern_id string, discovery_tier string, analysis_tier string, core_start int, core_end int, seqlet_count long"


def make_registry(spark: SparkSession, folder: str, seed: int, n_pos: int = 4, n_neg: int = 2, rows: int = 12, analysis: str = "a") -> None:
    """A core of half the rows in each pattern; contributions of the negative ones are below 0."""
    rng, nodes, matrices = random.Random(seed), [], []
    for metacluster, count, sign in (("pos", n_pos, 1), ("neg", n_neg, -1)):
        for k in range(count):
            name, start = f"{analysis}/{metacluster}/pattern_{k}", rows // 4
            inside = lambda i: start <= i < start + rows // 2  # noqa: E731, B023
            cwm = [[sign * rng.uniform(0.3, 1) if inside(i) else rng.uniform(-0.01, 0.01) for _ in range(4)] for i in range(rows)]
            ppm = [[abs(v) / sum(map(abs, row)) for v in row] for row in cwm]
            nodes.append((name, "m", "r", "c", metacluster, "U", f"U_UNASSIGNED_{len(nodes):02d}", "NA", name, "core", "core", start, start + rows // 2, rng.randrange(50, 500)))
            matrices += [(name, "cwm", cwm), (name, "ppm", ppm)]
    write_registry(folder, {"made_with_seed": seed}, spark.createDataFrame(nodes, NODES), spark.createDataFrame(matrices, "node_id string, kind string, mat array<array<double>>"))
