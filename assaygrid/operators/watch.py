"""Guards that are watched while a table is written: one scan gives the table and every verdict on it.

A watch is a few aggregate metrics of rows and a judgement over them.  Metrics ride on the scan by
``DataFrame.observe``, so no guard reads the table again.  Only whether a count is 0, a least and a greatest value are
judged: a stage that runs again after a lost executor can count a row twice, which changes none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.readers import STATES
from .guards import AXES, LEAST_N, NOT_ESTIMABLE, UNDERPOWERED, Verdict, low_confidence, output_mode


@dataclass(frozen=True)
class Watch:
    guard: str
    metrics: Mapping[str, Column]
    judge: Callable[[Mapping[str, Any]], str]  # what is wrong, or nothing


def no_row(guard: str, bad: Column, name: Column, said: str) -> Watch:
    """No row is bad; the verdict names the least of those that are."""
    bad = F.coalesce(bad, F.lit(False))
    return Watch(guard, {"bad": F.count_if(bad), "first": F.min(F.when(bad, F.coalesce(name.cast("string"), F.lit("(no name)"))))}, lambda m: f"{said}: {m['first']}" if m["bad"] else "")


def one_value(guard: str, *columns: str) -> Watch:
    """At least one row, and each column has one value, missing nowhere."""
    metrics: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for c in columns:
        metrics |= {f"{c}_null": F.count_if(F.col(c).isNull()), f"{c}_least": F.min(c), f"{c}_most": F.max(c)}

    def judge(m: Mapping[str, Any]) -> str:
        if not m["rows"]:
            return "no rows"
        return "; ".join(f"{c} is missing or not one" for c in columns if m[f"{c}_null"] or m[f"{c}_least"] != m[f"{c}_most"])

    return Watch(guard, metrics, judge)


def scale() -> Watch:
    return one_value("single_scale", "input_scale", "substrate_id")


def four_states(value: str = "hit_coefficient", state: str = "missingness", name: str = "region_id") -> Watch:
    used, v = F.col(state) == "used", F.col(value)
    return no_row("four_state_missingness", ~F.coalesce(F.col(state).isin(*STATES), F.lit(False)) | (~used & v.isNotNull()) | (used & (v.isNull() | F.isnan(v))), F.col(name), "no legal state, or a number that does not fit it")


def means() -> Watch:
    held = F.array_except(F.array(*map(F.lit, AXES)), F.coalesce("group_by", F.array().cast("array<string>")))
    return no_row("no_cross_model_cwm_avg", F.col("op").isin("mean", "average") & (F.size(held) > 0), F.col("id"), "a mean across an axis")


def unsigned(name: str = "source_node_id") -> Watch:
    return no_row("sign_alignment", ~F.col("registered_on").eqNullSafe("unsigned_ppm"), F.col(name), "registered on something else")


def interactions() -> Watch:
    wide = F.col("ci_low").isNull() | F.col("ci_high").isNull() | ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
    return no_row("interaction_required", F.col("is_specificity_claim") & wide, F.col("id"), "a claim of specificity without an interaction")


def estimable(least: int = LEAST_N) -> Watch:
    both = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0) & F.col("reference").between(F.col("ci_low"), F.col("ci_high"))
    return no_row("estimability_floor", F.col("n").isNull() | (~F.col("status").eqNullSafe(UNDERPOWERED) & ((F.col("n") < least) | F.coalesce(both, F.lit(False)))), F.col("id"), f"below N={least} or undecided, unmarked")


def weak_flags(name: str = "node_id", core: str = "core_length", source: str = "source", q: str = "q", seqlets: str = "seqlet_count") -> Watch:
    weak = low_confidence(F.col(core), F.col(source), F.col(q), F.col(seqlets))
    return no_row("short_motif_flag", weak & ~F.coalesce("low_confidence_annotation", F.lit(False)), F.col(name), "a weak motif without its flag")


def lone_families() -> Watch:
    alone = F.size(F.array_distinct(F.coalesce("families", F.array().cast("array<string>")))) <= 1
    return no_row("single_family_layer", alone & ((F.coalesce("within_peak_share", F.lit(0.0)) == 1) | ~F.col("status").eqNullSafe(NOT_ESTIMABLE)), F.col("id"), "a stratum of one family with a share")


def declared_modes() -> Watch:
    return no_row("selection_provenance_declared", ~F.col("output_mode").eqNullSafe(output_mode(F.col("selection_provenance"))), F.col("query_id"), "another mode than declared")


class Watched:
    """A table under watches; ``table`` is to be written (or read through) once, then ``verdicts`` are known."""

    def __init__(self, df: DataFrame, *watches: Watch):
        self.watches, self.seen = watches, Observation()
        self.table = df.observe(self.seen, *[c.alias(f"{i}.{k}") for i, w in enumerate(watches) for k, c in w.metrics.items()])

    def verdicts(self) -> list[Verdict]:
        got = self.seen.get
        faults = [(w, w.judge({k: got.get(f"{i}.{k}") for k in w.metrics})) for i, w in enumerate(self.watches)]
        return [Verdict(w.guard, not fault, fault or "nothing to object to") for w, fault in faults]
