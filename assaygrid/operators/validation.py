"""Validation of a merge: two hit tables before and after it, and the splits that such a claim may rest on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import affected_text, digest
from ..sources.readers import Refusal
from ..sources.scratch import discard, written
from .selection import counted, medians
from .stability import LEAST, TOLERANCE


class StabilityBackend(Protocol):
    """Anything that gives the tables before and after a decision."""

    name: str

    def compare(self, lexicons: Any, decision_id: str) -> tuple[DataFrame, DataFrame]: ...


class FrozenTables:
    """A backend over two tables made beforehand."""

    def __init__(self, before: DataFrame, after: DataFrame, name: str = "frozen"):
        self.before, self.after, self.name = before, after, name

    def compare(self, lexicons: Any, decision_id: str) -> tuple[DataFrame, DataFrame]:
        return self.before, self.after


NAMES = ("peak_id", "hit_id", "coefficient", "reconstruction")  # fixed value: columns of a table before or after


def lacking(df: DataFrame, side: str) -> None:
    missing = [c for c in NAMES if c not in df.columns]
    if missing:
        raise Refusal(f"{side}: missing columns {', '.join(missing)}")


def unfit(df: DataFrame) -> Column:
    """Whether a row of a hit table lacks a name or a finite number; only a text can be blank."""
    bad, kinds = F.lit(False), dict(df.select(*NAMES).dtypes)
    for c in NAMES[:2]:
        bad = bad | (F.coalesce(F.trim(c) == "", F.lit(True)) if kinds[c] == "string" else F.col(c).isNull())
    for c in NAMES[2:]:
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))
    return bad


def standard(df: DataFrame, side: str) -> DataFrame:
    """peak_id, hit_id, coefficient, reconstruction; named, finite, each hit once and one reconstruction a peak."""
    lacking(df, side)
    out = df.select(*NAMES)
    r = out.agg(F.count("*").alias("n"), F.count_if(unfit(df)).alias("bad")).first()
    if not r.n or r.bad:
        raise Refusal(f"{side}: {r.bad} of {r.n} rows without a name or a finite number" if r.n else f"{side}: no rows")
    again = out.groupBy("peak_id", "hit_id").count().filter("count > 1").limit(1).collect()
    if again:
        raise Refusal(f"{side}: hit {again[0].hit_id} of {again[0].peak_id} twice; a sum would make up a change")
    torn = out.groupBy("peak_id").agg(F.min("reconstruction").alias("a"), F.max("reconstruction").alias("b")).filter("a <> b").limit(1).collect()
    if torn:
        raise Refusal(f"{side}: peak {torn[0].peak_id} has two reconstructions")
    return out


def _changes(before: DataFrame, after: DataFrame, tolerance: float | None) -> DataFrame:
    """One row a peak: whether its hits changed, their sums, and whether both tables are sound there."""
    lacking(before, "before"), lacking(after, "after")
    told = lambda df, side: df.select("peak_id", "hit_id", F.col("coefficient").alias(side), F.col("reconstruction").alias(f"{side}_r"), F.lit(1).alias(f"{side}_n"), unfit(df).alias("bad"))
    sides = told(before, "old").unionByName(told(after, "new"), allowMissingColumns=True)
    ends = ((F.min, "min"), (F.max, "max"))
    both = sides.groupBy("peak_id", "hit_id").agg(F.max("old").alias("old"), F.max("new").alias("new"), *[f(f"{s}_r").alias(f"{s}_{n}") for s in ("old", "new") for f, n in ends], F.count("old_n").alias("old_n"), F.count("new_n").alias("new_n"), F.bool_or("bad").alias("bad"))
    changed = F.col("old").isNull() | F.col("new").isNull()
    if tolerance is not None:
        changed = changed | (F.abs(F.col("new") - F.col("old")) > tolerance)
    shared = F.col("old").isNotNull() & F.col("new").isNotNull()
    fit = ~F.col("bad") & (F.col("old_n") < 2) & (F.col("new_n") < 2)
    own = both.groupBy("peak_id").agg(
        F.bool_or(changed).alias("hot"), F.count("*").alias("union"), F.count_if(shared).alias("shared"), F.sum(F.abs("new")).alias("mass"), F.bool_and(fit).alias("fit"),
        *[F.sum(F.when(shared, x)).alias(n) for n, x in (("so", F.col("old")), ("sn", F.col("new")), ("soo", F.col("old") ** 2), ("snn", F.col("new") ** 2), ("sno", F.col("old") * F.col("new")))],
        *[f(f"{s}_{n}").alias(f"{s}_{n}") for s in ("old", "new") for f, n in ends],
    )
    # one reconstruction on either side: both tables have the peak
    one = lambda s: F.coalesce(F.col(f"{s}_min") == F.col(f"{s}_max"), F.lit(False))
    sound = F.col("fit") & one("old") & one("new")
    return own.withColumns({"sound": sound, "delta": F.col("new_min") - F.col("old_min")}).drop("fit", "old_min", "old_max", "new_min", "new_max")


def stability(decision_id: str, before: DataFrame, after: DataFrame, tolerance: float | None = TOLERANCE) -> dict[str, Any]:
    """One row of figures over the peaks whose hits changed (J05, J06, A15); ``tolerance`` None counts changed sets alone.

    Each table is read once: what would refuse it is counted on the way to the table of peaks, and ``standard`` looks
    for the row to name only where something was found.
    """
    own = written(_changes(before, after, tolerance), "changes")
    hot = lambda x: F.when(F.col("hot"), x)
    r = own.agg(
        F.count_if("hot").alias("peaks"), F.sum(hot(F.col("union"))).alias("hits"), F.sum(hot(F.col("shared"))).alias("n"), F.sum(hot(F.col("mass"))).alias("part"), F.sum("mass").alias("whole"),
        *[F.sum(hot(F.col(c))).alias(c) for c in ("so", "sn", "soo", "snn", "sno")], F.count("*").alias("every"), F.bool_and("sound").alias("sound"),
    ).first()
    if not r.every or not r.sound:
        standard(before, "before"), standard(after, "after")
        raise Refusal("the two tables cover other peaks")
    deltas = counted(own.withColumn("grp", F.explode(F.when(F.col("hot"), F.array(F.lit("every"), F.lit("affected"))).otherwise(F.array(F.lit("every"))))), F.col("grp"), F.col("delta"))
    middle = {m.grp: m.middle for m in medians(deltas).collect()}
    discard(own)
    n, pearson = r.n or 0, None
    if n >= 2 and (vx := n * r.soo - r.so**2) > 0 and (vy := n * r.snn - r.sn**2) > 0:
        pearson = (n * r.sno - r.so * r.sn) / (vx**0.5 * vy**0.5)
    status = "LOW_RISK_RARE_NOT_VALIDATED" if r.peaks < LEAST else "STABLE_AFFECTED_SUBSET" if abs(middle["affected"]) <= 1e-12 else "CHANGED_AFFECTED_SUBSET"
    said = f"{r.peaks} affected peaks are below {LEAST}: no claim" if r.peaks < LEAST else f"descriptive for {r.peaks} affected peaks; no claim of equivalence"
    out = {
        "decision_id": decision_id, "n_affected_peaks": r.peaks, "n_affected_hits": r.hits or 0, "affected_coefficient_share": (r.part or 0.0) / r.whole if r.whole else 0.0, "affected_definition": affected_text(tolerance),
        "paired_delta_reconstruction_affected": middle.get("affected"), "paired_delta_reconstruction_all": middle.get("every"), "hit_jaccard": n / r.hits if r.hits else None, "coefficient_conservation": pearson, "status": status, "power_statement": said,
    }
    return {**out, "result_id": digest(out)}


def validate(backends: Sequence[StabilityBackend], lexicons: Any, decisions: Sequence[str]) -> tuple[list[dict[str, Any]], list[dict[str, str]]]:
    """Results of every backend for every decision; a backend that is not there is UNVERIFIED, not silent."""
    results, log = [], []
    for b in backends:
        for d in decisions:
            try:
                results.append({"backend": b.name, **stability(d, *b.compare(lexicons, d))})
                log.append({"backend": b.name, "decision_id": d, "status": "VERIFIED", "reason": ""})
            except Refusal:
                raise
            except Exception as error:
                log.append({"backend": b.name, "decision_id": d, "status": "UNVERIFIED", "reason": str(error)})
    return results, log


def stability_of(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """decisions with their one row of results (decision_id); two rows for a decision are refused (J12); required fields are columns."""
    need = ("decision_id", "status", "n_affected_peaks")
    if any(c not in results.columns for c in need):
        raise Refusal(f"results lack {[c for c in need if c not in results.columns]}")
    again = results.groupBy("decision_id").count().filter("count > 1").limit(1).collect()
    if again:
        raise Refusal(f"two results of {again[0].decision_id}")
    return decisions.join(results, "decision_id", "left")


ALLOWED = {"decision": ("DISCOVERY", "ADJUDICATION"), "validation": ("VALIDATION",)}  # fixed values


def check_split(splits: DataFrame, decision: DataFrame, validation: DataFrame, mode: str = "PRIMARY") -> None:
    """Peaks of a decision and of its validation against the split manifest (peak_id, role)."""
    for name, df in (("decision", decision), ("validation", validation)):
        unknown = df.join(splits, "peak_id", "left_anti").limit(1).collect()
        if unknown:
            raise Refusal(f"{name}: peak {unknown[0].peak_id} is not in the split manifest")
        if mode == "PRIMARY":
            other = df.join(splits, "peak_id").filter(~F.col("role").isin(*ALLOWED[name])).limit(1).collect()
            if other:
                raise Refusal(f"{name}: peak {other[0].peak_id} has role {other[0].role}")
    if mode == "PRIMARY" and decision.join(validation, "peak_id", "left_semi").take(1):
        raise Refusal("a peak decides and validates")


def check_cross_fit(peaks: DataFrame, folds: DataFrame) -> DataFrame:
    """folds (fold_id, peak_id, side in decision/evaluation): each peak is evaluated once and decides in all other folds."""
    n = folds.agg(F.count_distinct("fold_id")).first()[0]
    if n < 2:
        raise Refusal("a cross-fit has two folds")
    per = folds.groupBy("peak_id").agg(F.count_if(F.col("side") == "evaluation").alias("e"), F.count_if(F.col("side") == "decision").alias("d"), F.count_distinct("fold_id").alias("f"))
    bad = peaks.select("peak_id").join(per, "peak_id", "full").filter((F.coalesce("e", F.lit(0)) != 1) | (F.coalesce("d", F.lit(0)) != n - 1) | (F.coalesce("f", F.lit(0)) != n)).limit(1).collect()
    if bad or folds.join(peaks, "peak_id", "left_anti").take(1):
        raise Refusal(f"peak {bad[0].peak_id if bad else '?'} is not evaluated once and decided on elsewhere")
    return folds.groupBy("fold_id").agg(F.count_if(F.col("side") == "evaluation").alias("evaluated"), F.count_if(F.col("side") == "decision").alias("complement"))


def compare_runs(a: DataFrame, b: DataFrame, regions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Two runs of a caller over the regions both were given (peak, motif, start, strand, coefficient)."""
    key = ["peak", "motif", "start", "strand"]
    inside = lambda df: df.join(regions, "peak", "left_semi")
    both = inside(a).select(*key, F.col("coefficient").alias("x")).join(inside(b).select(*key, F.col("coefficient").alias("y")), key, "full").select("x", "y", F.abs(F.col("y") - F.col("x")).alias("d"))
    both = written(both, "runs")
    moved = F.when(F.col("d") > tolerance, F.col("d"))
    counts = both.agg(F.count_if(F.col("y").isNull()).alias("dropped"), F.count_if(F.col("x").isNull()).alias("gained"), F.try_divide(F.count("d"), F.count("*")).alias("jaccard"), F.count(moved).alias("changed"), F.max("d").alias("max_delta"))
    middle = medians(counted(both, F.lit("moved"), moved)).collect()
    return counts.withColumn("upper_median", F.lit(middle[0].upper if middle else None).cast("double"))


def ladder(rows: DataFrame, sizes: Sequence[int], key: str = "row_id", seed: int = 0) -> DataFrame:
    """rows with the smallest of the nested seeded subsets that each is in (null: in none)."""
    from pyspark.sql import Window as W

    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    first = rows.withColumn("__h", drawn).orderBy("__h", key).limit(max(sizes))  # the largest rung bounds the rest
    step = F.lit(None).cast("int")
    for n in sorted(sizes, reverse=True):
        step = F.when(F.col("__place") <= n, n).otherwise(step)
    return first.withColumn("__place", F.row_number().over(W.orderBy("__h", key))).withColumn("rung", step).drop("__place", "__h")


def artifact(kind: str, payload: Mapping[str, Any]) -> dict[str, Any]:
    """A split artifact with its identity."""
    body = {"kind": kind, **payload}
    return {**body, "artifact_id": digest(body)}
