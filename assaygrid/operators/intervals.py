"""Whole bias-corrected and accelerated intervals from the block replicates, the jackknife and the point effect."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relations import CATALOGUE as C
from ..sources.scratch import ship, written
from . import effects  # noqa: F401
from .selection import placed

LEAST = 30  # fixed value: blocks and replicates below which no interval is given
NORMAL = NormalDist()


def bca_limits(replicates: np.ndarray, proportion: float, acceleration: float, alpha: float = 0.05) -> tuple[float, float]:
    """Both ends; ``proportion`` is the tie-aware share of replicates below the effect, inside (0, 1)."""
    z0 = NORMAL.inv_cdf(proportion)

    def place(z: float) -> float:
        rest = 1 - acceleration * (z0 + z)
        if rest == 0:
            return 1.0 if z0 + z > 0 else 0.0
        return min(1.0, max(0.0, NORMAL.cdf(z0 + (z0 + z) / rest)))

    z = NORMAL.inv_cdf(alpha / 2)
    low, high = np.quantile(replicates, sorted((place(z), place(-z))))
    return float(low), float(high)


def bca_intervals(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """family, effect, ci_low, ci_high, n_blocks, n_replicates, status of the relation ``bca_parts``; refused (null ends) below the floor.

    A family brings one array of replicates, whose number is the bootstrap's own parameter.
    """
    ship(parts.sparkSession)

    @F.pandas_udf("struct<ci_low:double,ci_high:double>")
    def limits(replicates, proportion, acceleration):
        import pandas as pd

        ends = [bca_limits(np.asarray(r), p, a) if len(r) >= least else (None, None) for r, p, a in zip(replicates, proportion, acceleration, strict=True)]
        return pd.DataFrame(ends, columns=["ci_low", "ci_high"], dtype="float64")

    out = parts.withColumn("ci", limits("reps", "proportion", "acceleration")).withColumn("enough", (F.col("n_blocks") >= least) & (F.size("reps") >= least))
    end = lambda c: F.when(F.col("enough"), F.round(f"ci.{c}", 9)).alias(c)
    return out.select("family", "effect", end("ci_low"), end("ci_high"), "n_blocks", F.size("reps").alias("n_replicates"), F.when(F.col("enough"), "ESTIMATED").otherwise("REFUSED").alias("status"))


def effect_ci_bca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bca_intervals(C.run("bca_parts")(spark, sf_dir))


def bca_of(blocks: DataFrame, statistic, n_bootstrap: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """family, estimate, ci_low, ci_high of any two-sample statistic of (values of the query, values of the comparator).

    ``blocks`` has family, block, q and c (arrays of values); whole blocks are drawn, and one family's blocks are one
    group, as the statistic asks for all values at once (``bca_merged`` takes one that reads sums).  Fewer than 30 blocks, or replicates, give null ends.
    """
    ship(blocks.sparkSession)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        q, c, n = [list(x) for x in pdf.q], [list(x) for x in pdf.c], len(pdf)

        def value(chosen):
            a, b = [v for i in chosen for v in q[i]], [v for i in chosen for v in c[i]]
            return float(statistic(a, b)) if a and b else None

        whole, rng = value(range(n)), np.random.default_rng(seed)
        left = [x for x in (value([j for j in range(n) if j != i]) for i in range(n)) if x is not None] if n >= LEAST else []
        reps = [x for x in (value(rng.integers(0, n, n)) for _ in range(n_bootstrap)) if x is not None] if n >= LEAST else []
        low = high = None
        if whole is not None and len(left) >= LEAST and len(reps) >= LEAST:
            d, r = np.mean(left) - np.array(left), np.array(reps)
            bottom = (d**2).sum() ** 1.5
            share = ((r < whole).sum() + (r <= whole).sum()) / (2 * len(r))
            low, high = bca_limits(r, float(np.clip(share, 0.5 / len(r), 1 - 0.5 / len(r))), float((d**3).sum() / (6 * bottom)) if bottom else 0.0, alpha)
        return pd.DataFrame({"family": [pdf.family.iloc[0]], "estimate": pd.Series([whole], dtype="float64"), "ci_low": pd.Series([low], dtype="float64"), "ci_high": pd.Series([high], dtype="float64")})

    return blocks.groupBy("family").applyInPandas(run, "family string, estimate double, ci_low double, ci_high double")


def block_states(blocks: DataFrame, init) -> DataFrame:
    """family, block, state of (family, block, q, c): what ``init(values of the query, values of the comparator)`` makes of a block, an array of numbers that add up."""
    ship(blocks.sparkSession)

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            yield pd.DataFrame({"family": pdf.family, "block": pdf.block, "state": [[float(x) for x in init(q, c)] for q, c in zip(pdf.q, pdf.c, strict=True)]})

    kinds = {c: blocks.schema[c].dataType.simpleString() for c in ("family", "block")}
    return blocks.select("family", "block", "q", "c").mapInPandas(run, f"family {kinds['family']}, block {kinds['block']}, state array<double>")


def drawn(seed: int, r: int, n: int) -> np.ndarray:
    """How often replicate r draws each of n blocks: the same in every task."""
    return np.bincount(np.random.default_rng((seed, r)).integers(0, n, n), minlength=n)


def bca_merged(states: DataFrame, finish, n_bootstrap: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """family, estimate, ci_low, ci_high, n_blocks, n_replicates of any statistic of sums of blocks' states.

    ``states`` has family, block and state (``block_states``); ``finish(state) -> number or None`` reads the statistic off
    a sum.  States are summed for each replicate inside tasks, then over tasks; leaving a block out is the whole
    sum less its state.  So no family's blocks or values meet in one task, and what a family brings together is one
    number for each replicate.  Draws depend on the seed, the replicate and the number of blocks alone.
    Fewer than 30 blocks, or replicates that have a value, give null ends.
    """
    spark = states.sparkSession
    ship(spark)
    kind = states.schema["family"].dataType.simpleString()
    placed_ = placed(states.select("family", "block", "state"), "family", "block", "k")
    sized = placed_.join(placed_.groupBy("family").agg(F.count("*").alias("n")), "family")
    sized = written(sized, "states")

    def sums(pdfs):
        import pandas as pd

        for pdf in pdfs:
            for (family, n), own in pdf.groupby(["family", "n"]):
                x, k = np.array(own.state.tolist()), own.k.to_numpy()
                yield pd.DataFrame({"family": family, "r": np.arange(-1, n_bootstrap), "state": [x.sum(0).tolist(), *((drawn(seed, r, int(n))[k] @ x).tolist() for r in range(n_bootstrap))]})

    # replicate -1 is the whole; a state is summed place by place
    parts = sized.mapInPandas(sums, f"family {kind}, r int, state array<double>").select("family", "r", F.posexplode("state").alias("i", "x"))
    added = parts.groupBy("family", "r", "i").agg(F.sum("x").alias("x")).groupBy("family", "r").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    added = written(added.select("family", "r", F.transform("s", lambda p: p["x"]).alias("state")), "sums")

    @F.pandas_udf("double")
    def value(state):
        import pandas as pd

        return pd.Series([finish(np.asarray(s)) for s in state], dtype="float64")

    reps = written(added.select("family", "r", value("state").alias("v")), "replicates")
    whole = added.filter("r = -1").select("family", F.col("state").alias("total"))
    left = sized.join(whole, "family").select("family", value(F.zip_with("total", "state", lambda a, b: a - b)).alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    left = written(left, "left-out")
    middle = left.groupBy("family").agg(F.avg("v").alias("m"))
    bent = left.join(middle, "family").withColumn("d", F.col("m") - F.col("v")).groupBy("family").agg(F.count("*").alias("n_left"), F.sum(F.col("d") ** 2).alias("d2"), F.sum(F.col("d") ** 3).alias("d3"))
    good = reps.filter("r >= 0 AND v IS NOT NULL AND NOT isnan(v)").groupBy("family").agg(F.collect_list("v").alias("reps"))
    point = reps.filter("r = -1").select("family", F.col("v").alias("estimate"))
    rows = point.join(sized.groupBy("family").agg(F.count("*").alias("n_blocks")), "family").join(bent, "family", "left").join(good, "family", "left")

    @F.pandas_udf("struct<ci_low:double,ci_high:double>")
    def limits(estimate, n_left, d2, d3, found):
        import pandas as pd

        out = []
        for e, n, s2, s3, r in zip(estimate, n_left, d2, d3, found, strict=True):
            if r is None or len(r) < LEAST or not n >= LEAST or e is None or e != e:
                out.append((None, None))
                continue
            r = np.sort(np.asarray(r))
            share = ((r < e).sum() + (r <= e).sum()) / (2 * len(r))
            out.append(bca_limits(r, float(np.clip(share, 0.5 / len(r), 1 - 0.5 / len(r))), float(s3 / (6 * s2**1.5)) if s2 > 0 else 0.0, alpha))
        return pd.DataFrame(out, columns=["ci_low", "ci_high"], dtype="float64")

    return rows.withColumn("ci", limits("estimate", "n_left", "d2", "d3", "reps")).select("family", "estimate", "ci.ci_low", "ci.ci_high", "n_blocks", F.coalesce(F.size("reps"), F.lit(0)).alias("n_replicates"))
