"""Guards: each is a boolean over an aggregate of the table about to be written, as one row (guard, passed, detail).

A guard reads its table once and leaves rows where they are; only the verdict, a count and at most five offenders
come to the driver.  ``run_guards`` runs every guard whose input is given; ``require`` logs outcomes before refusing.
"""

from __future__ import annotations

import ast
import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import STATES, Refusal

# Axes that a mean must hold fixed, floors, modes of a reading.
AXES = ("model", "readout", "metacluster")
LEAST_N, SHORT_CORE, FEW_SEQLETS, WEAK_Q, COVERAGE_TOLERANCE = 30, 6, 100, 0.05, 1e-4
HEALTH = ("intersection_coverage", "n_blocks", "explained_fraction")
MODES = {
    "EXTERNAL": "FULL_INFERENCE", "PROGRAMMATIC_RULE": "FULL_INFERENCE", "CLUSTERED_WITH_SPLIT": "FULL_INFERENCE_HELD_OUT", "CLUSTERED_NO_SPLIT": "DESCRIPTIVE_ONLY", "EYEBALLED": "DESCRIPTIVE_ONLY",
    "MODEL_SELECTED_NO_TRANSCRIPT": "DESCRIPTIVE_ONLY_UNVERIFIABLE_CONDITIONING", "DECLARATION_MISSING": "DESCRIPTIVE_ONLY_UNVERIFIABLE_CONDITIONING",
}
STRICTEST = "DESCRIPTIVE_ONLY_UNVERIFIABLE_CONDITIONING"
UNDERPOWERED, NOT_ESTIMABLE = "NOT_ESTIMABLE_UNDERPOWERED", "NOT_ESTIMABLE"
IDENTIFIERS = {"variant_id", "pattern_key", "motif_name", "node_id", "region_id", "peak_id"}
CUTS = {"split", "startswith", "endswith", "strip", "removeprefix"}


class GuardRefusal(Refusal):
    """A guard failed, as against a table or a declaration that cannot be read."""


@dataclass(frozen=True)
class Verdict:
    guard: str
    passed: bool
    detail: str


def _no(df: DataFrame, bad: Column, guard: str, name: str, said: str, fine: str) -> Verdict:
    """Passed if no row is bad; else how many are, and the first five by name."""
    rows = df.filter(F.coalesce(bad, F.lit(False))).select(F.col(name).cast("string").alias("x"))
    n = rows.count()
    return Verdict(guard, not n, f"{n} {said}: {', '.join(str(r.x) for r in rows.orderBy('x').limit(5).collect())}" if n else fine)


def single_scale(hits: DataFrame) -> Verdict:
    """One input scale and one substrate, missing nowhere, over at least one row."""
    keys = [c for c in ("input_scale", "substrate_id") if c in hits.columns]
    r = hits.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in keys], *[F.count_distinct(c).alias(c) for c in keys]).first()
    faults = [f"{r[f'no_{c}']} rows without {c}" for c in keys if r[f"no_{c}"]] + [f"{r[c]} values of {c}" for c in keys if r[c] > 1]
    if not r.n or "input_scale" not in keys:
        faults = ["no row carries an input_scale"]
    return Verdict("single_scale", not faults, "; ".join(faults) or "one input scale")


def variant_id_unique(nodes: DataFrame) -> Verdict:
    """variant_id and denovo_pattern_id repeat nowhere, so each names the other."""
    faults = []
    for c in ("variant_id", "denovo_pattern_id"):
        again = nodes.groupBy(c).count().filter("count > 1")
        if n := again.count():
            faults.append(f"{n} values of {c} repeat: {', '.join(str(r[0]) for r in again.orderBy(c).limit(5).collect())}")
    return Verdict("variant_id_unique", not faults, "; ".join(faults) or "variant ids and patterns name each other")


def no_key_parsing(source: str) -> Verdict:
    """No slice of an identifier and no prefix test on one, as far as the syntax shows."""
    bad = []
    for node in ast.walk(ast.parse(source)):
        of = node.value if isinstance(node, ast.Subscript) else node.func.value if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in CUTS else None
        name = getattr(of, "id", None) or getattr(of, "attr", None)
        if name in IDENTIFIERS:
            bad.append(f"line {node.lineno}: {name}")
    return Verdict("no_key_parsing", not bad, "; ".join(bad) or "no identifier is cut in this text")


def four_state_missingness(hits: DataFrame, counts: Mapping[str, float], value: str = "hit_coefficient", state: str = "missingness") -> Verdict:
    """Only the four states, no number where nothing was used, and the claimed counts as counted again."""
    used = F.col(state) == "used"
    r = hits.agg(
        F.count("*").alias("total"), F.count_if(used).alias("defined"), F.count_if(~F.coalesce(F.col(state).isin(*STATES), F.lit(False))).alias("illegal"), F.count_if(~used & F.col(value).isNotNull()).alias("filled"),
        F.count_if(used & (F.col(value).isNull() | F.isnan(value))).alias("blank"),
    ).first()
    faults = [f"{r[k]} rows {what}" for k, what in (("illegal", "in no legal state"), ("filled", "with a number but not used"), ("blank", "used without a number")) if r[k]]
    now = {"total": r.total, "defined": r.defined, "coverage": r.defined / r.total if r.total else None}
    for k, claimed in counts.items():
        if now[k] is None or abs(claimed - now[k]) > (COVERAGE_TOLERANCE if k == "coverage" else 0):
            faults.append(f"{k} claimed {claimed}, counted {now[k]}")
    return Verdict("four_state_missingness", not faults, "; ".join(faults) or f"{r.defined} of {r.total} rows defined")


def no_cross_model_cwm_avg(operations: DataFrame) -> Verdict:
    """A mean holds model, readout and metacluster fixed (id, op, group_by array)."""
    held = F.array_except(F.array(*map(F.lit, AXES)), F.coalesce("group_by", F.array().cast("array<string>")))
    return _no(operations, F.col("op").isin("mean", "average") & (F.size(held) > 0), "no_cross_model_cwm_avg", "id", "means across model, readout or metacluster", "no recorded mean crosses an axis")


def sign_alignment(edges: DataFrame) -> Verdict:
    """Pairs were registered on unsigned matrices."""
    bad = ~F.col("registered_on").eqNullSafe("unsigned_ppm")
    if "signed_similarity_used_for_registration" in edges.columns:
        bad = bad | F.coalesce("signed_similarity_used_for_registration", F.lit(False))
    return _no(edges, bad, "sign_alignment", "registered_on", "pairs registered on something else", "registration is unsigned")


def interaction_required(specificity: DataFrame) -> Verdict:
    """A claim of specificity has an interaction interval that leaves out 0."""
    wide = F.col("ci_low").isNull() | F.col("ci_high").isNull() | ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
    by_stars = F.col("derived_from") == "difference_of_significance" if "derived_from" in specificity.columns else F.lit(False)
    return _no(specificity, F.col("is_specificity_claim") & (wide | F.coalesce(by_stars, F.lit(False))), "interaction_required", "id", "claims of specificity without an interaction", "each claim of specificity has its interaction")


def estimability_floor(cells: DataFrame, least: int = LEAST_N) -> Verdict:
    """N of at least 30, or marked; so is an interval that holds both 0 and the reference."""
    unmarked = ~F.col("status").eqNullSafe(UNDERPOWERED)
    both = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0) & F.col("reference").between(F.col("ci_low"), F.col("ci_high"))
    return _no(cells, F.col("n").isNull() | (unmarked & ((F.col("n") < least) | F.coalesce(both, F.lit(False)))), "estimability_floor", "id", f"cells below N={least} or undecided, unmarked", f"every cell has N>={least} or is marked")


def stratum_parity(rules: DataFrame) -> Verdict:
    """Each stratifying variable follows one rule (variable, rule)."""
    return _no(rules.groupBy("variable").agg(F.count_distinct("rule").alias("n")), F.col("n") > 1, "stratum_parity", "variable", "variables with several rules", "one rule for each variable")


def low_confidence(core: Column, source: Column, q: Column, seqlets: Column) -> Column:
    """A core of at most 6 rows, a weak match of the one database that has q, or few seqlets; what is missing accuses nobody."""
    weak = (F.lower(source) == "tomtom") & (q > WEAK_Q)
    return F.coalesce(core <= SHORT_CORE, F.lit(False)) | F.coalesce(weak, F.lit(False)) | F.coalesce(seqlets < FEW_SEQLETS, F.lit(False))


def short_motif_flag(nodes: DataFrame) -> Verdict:
    """Short and weak motifs carry their flag (variant_id, core_length, tomtom_q, seqlet_count, low_confidence_annotation)."""
    number = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in ("core_length", "tomtom_q", "seqlet_count")}
    odd = F.lit(False)
    for c, x in number.items():
        odd = odd | (F.col(c).isNotNull() & (x.isNull() | F.isnan(x)))
    weak = low_confidence(number["core_length"], F.lit("tomtom"), number["tomtom_q"], number["seqlet_count"])
    marked = nodes.withColumns({"__odd": odd | F.coalesce(number["core_length"] < 0, F.lit(False)), "__weak": weak & ~F.coalesce("low_confidence_annotation", F.lit(False))})
    out = _no(marked, F.col("__odd"), "short_motif_flag", "variant_id", "nodes whose figures are no numbers", "")
    if out.passed:
        unmeasured = nodes.filter(F.col("core_length").isNull()).count()
        out = _no(marked, F.col("__weak"), "short_motif_flag", "variant_id", "unflagged weak motifs", f"every weak motif is flagged; {unmeasured} declare no core")
    return out


def single_family_layer(strata: DataFrame) -> Verdict:
    """A stratum of one family has no share (id, families array, within_peak_share, status) (X11)."""
    alone = F.size(F.array_distinct(F.coalesce("families", F.array().cast("array<string>")))) <= 1
    return _no(strata, alone & ((F.coalesce("within_peak_share", F.lit(0.0)) == 1) | ~F.col("status").eqNullSafe(NOT_ESTIMABLE)), "single_family_layer", "id", "strata of one family with a share", "strata of one family are not estimated")


def output_mode(provenance: Column) -> Column:
    """The mode that a declared provenance leads to; what is undeclared or unknown takes the strictest."""
    out = F.lit(STRICTEST)
    for k, v in MODES.items():
        out = F.when(provenance == k, v).otherwise(out)
    return out


def selection_provenance_declared(queries: DataFrame) -> Verdict:
    """Every query declares how its set was chosen and ran in the mode of that."""
    if "selection_provenance" not in queries.columns:
        return Verdict("selection_provenance_declared", False, "no selection_provenance at all")
    return _no(queries, ~F.col("output_mode").eqNullSafe(output_mode(F.col("selection_provenance"))), "selection_provenance_declared", "query_id", "queries in another mode than declared", "every query ran in its declared mode")


def health_before_effect(report: Mapping[str, Any]) -> Verdict:
    """Health numbers come first, and a failed floor keeps effects back."""
    health, failures, order = report.get("health") or {}, list(report.get("floor_failures") or ()), list(report.get("emitted_order") or ())
    faults = []
    if absent := [k for k in HEALTH if k not in health]:
        faults.append(f"health numbers absent: {absent}")
    elif [k for k in HEALTH if health[k] is None] and not failures:
        faults.append("a health number is null and no floor failed")
    if order[:1] != ["health"]:
        faults.append(f"health is not first in {order}")
    if failures and (report.get("effects") or report.get("interpretation_emitted")):
        faults.append(f"a reading in spite of failed floors: {failures}")
    return Verdict("health_before_effect", not faults, "; ".join(faults) or "health first")


def comparator_declared(effects: DataFrame) -> Verdict:
    """Each effect is against exactly one named set (id, comparator_id[, is_cross_condition])."""
    cross = effects.filter(F.coalesce("is_cross_condition", F.lit(True))) if "is_cross_condition" in effects.columns else effects
    named = F.when(~F.col("comparator_id").isin("", "NA"), F.col("comparator_id"))
    per = cross.groupBy("id").agg(F.count_distinct(named).alias("n"), F.count_if(named.isNull()).alias("blank"))
    return _no(per, (F.col("n") != 1) | (F.col("blank") > 0), "comparator_declared", "id", "effects without one comparator", "one comparator for each effect")


def index_order_matches_loader(index: DataFrame, loader: DataFrame) -> Verdict:
    """Both lists (place, name) hold the same names in the same order; compared by name."""
    guard = "index_order_matches_loader"
    for label, df in (("index", index), ("loader", loader)):
        n = df.agg(F.count("*").alias("n"), F.count_distinct("name").alias("d")).first()
        if not n.n or n.n != n.d:
            return Verdict(guard, False, f"the {label} has {n.n} names, {n.d} of them distinct")
    both = index.select("name", F.col("place").alias("i")).join(loader.select("name", F.col("place").alias("l")), "name", "full")
    r = both.agg(F.count_if(F.col("l").isNull()).alias("only_index"), F.count_if(F.col("i").isNull()).alias("only_loader"), F.min(F.when(F.col("i") != F.col("l"), F.col("i"))).alias("first")).first()
    if r.only_index or r.only_loader:
        return Verdict(guard, False, f"{r.only_index} names only in the index, {r.only_loader} only in the loader")
    return Verdict(guard, r["first"] is None, "same order" if r["first"] is None else f"the order differs from place {r['first']}")


def no_cross_estimand_pooling(summaries: DataFrame, specs: DataFrame) -> Verdict:
    """A summary's cells belong, by the manifest, to the one estimand it names (group_key, estimand_id, cell_ids; cell_id, estimand_id)."""
    cells = summaries.select("group_key", F.col("estimand_id").alias("said"), F.explode_outer("cell_ids").alias("cell_id"))
    joined = cells.join(specs.select("cell_id", F.col("estimand_id").alias("real")), "cell_id", "left")
    per = joined.groupBy("group_key").agg(F.count_if(F.col("cell_id").isNull() | F.col("real").isNull()).alias("unknown"), F.count_distinct("real").alias("n"), F.count_if(F.col("said").isNotNull() & (F.col("said") != F.col("real"))).alias("wrong"))
    return _no(per, (F.col("unknown") > 0) | (F.col("n") > 1) | (F.col("wrong") > 0), "no_cross_estimand_pooling", "group_key", "summaries over several or unknown estimands", "each summary stays in one estimand")


GUARDS: dict[str, Callable[..., Verdict]] = {
    f.__name__: f
    for f in (single_scale, variant_id_unique, no_key_parsing, four_state_missingness, no_cross_model_cwm_avg, sign_alignment, interaction_required, estimability_floor, stratum_parity, short_motif_flag, single_family_layer, selection_provenance_declared, health_before_effect, comparator_declared, index_order_matches_loader, no_cross_estimand_pooling)
}


def run_guards(inputs: Mapping[str, Any]) -> list[Verdict]:
    """Every guard whose required arguments are all among the inputs, by the names in its signature."""
    out = []
    for f in GUARDS.values():
        needs = inspect.signature(f).parameters
        if all(p.default is not p.empty or n in inputs for n, p in needs.items()) and any(n in inputs for n in needs):
            out.append(f(**{n: inputs[n] for n in needs if n in inputs}))
    return out


def verdicts(spark: SparkSession, found: list[Verdict]) -> DataFrame:
    return spark.createDataFrame([(v.guard, v.passed, v.detail) for v in found], "guard string, passed boolean, detail string")


def require(found: list[Verdict], log=None, subject: str = "") -> None:
    """Log each verdict, then refuse if one failed."""
    for v in found:
        if log is not None:
            log.record(v, subject)
    failed = [v for v in found if not v.passed]
    if failed:
        raise GuardRefusal("; ".join(f"{v.guard}: {v.detail}" for v in failed))
