"""One question to a frozen hit table: which families a set of regions holds, and how it differs from a comparator.

``interpret`` takes a checked hit table and two sets of region ids and returns what their provenance licenses: health
first, then composition, then effects.  Tables stay distributed; what comes to the driver is one row for each side, and
one for each family of the lexicon.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import MISSING
from ..plans.relations import CATALOGUE as C
from ..sources.readers import Refusal, check_hits
from ..sources.scratch import discard, written
from . import effects, regions  # noqa: F401
from .guards import MODES, STRICTEST, comparator_declared, health_before_effect, require, selection_provenance_declared, single_scale
from .intervals import bca_intervals

# Features that come from attribution, licenses, estimators, floors, sizes.
ATTRIBUTION = {
    "attribution_pc1", "attribution_pc2", "attribution_score", "attribution_magnitude", "deepshap_score", "deeplift_score", "hypothetical_contrib_sum", "contrib_score_sum", "modisco_seqlet_score", "hit_coefficient", "hit_coefficient_sum",
}
LICENSES = {"EXTERNAL": "FULL_INFERENCE", "PROGRAMMATIC_RULE": "FULL_INFERENCE", "CLUSTERED_WITH_SPLIT": "HELD_OUT_INFERENCE"}
UNVERIFIABLE = {"MODEL_SELECTED_NO_TRANSCRIPT", "DECLARATION_MISSING"}
ESTIMATORS = {"percentile": "percentile_block_bootstrap", "bca-wild": "wild_cluster_bootstrap_t"}
CAPABILITY = {"percentile_block_bootstrap": "ESTIMATION_ONLY", "bca_paired_block_bootstrap": "ESTIMATION_ONLY", "wild_cluster_bootstrap_t": "INTERVAL_AND_TEST"}
BLOCK, REPLICATES, LEAST_REPLICATES = 1_000_000, 2000, 39


@dataclass(frozen=True)
class Floors:
    coverage: float = 0.90
    blocks: int = 30
    explained: float = 0.50


@dataclass(frozen=True)
class Query:
    """Two sets of regions (DataFrames with region_id) and how the first one came about."""

    query_id: str
    regions: DataFrame
    comparator: DataFrame | None = None
    comparator_id: str = MISSING
    provenance: str = "DECLARATION_MISSING"
    rule: str | None = None
    features: Sequence[str] = ()
    held_out: DataFrame | None = None


@dataclass
class Reading:
    query_id: str
    selection_provenance: str
    statistical_license: str
    claim_scope: str
    output_mode: str
    estimator: str
    inference_capability: str
    block_size: int
    n_bootstrap: int
    random_seed: int
    comparator_id: str = MISSING
    substrate_id: str = MISSING
    lexicon_id: str = MISSING
    input_scale: int | None = None
    health: dict[str, Any] = field(default_factory=dict)
    comparator_health: dict[str, Any] | None = None
    contrast: dict[str, Any] = field(default_factory=dict)
    floor_failures: list[str] = field(default_factory=list)
    suppression: str | None = None
    emitted_order: list[str] = field(default_factory=lambda: ["health"])
    composition: list[dict[str, Any]] | None = None
    effects: list[dict[str, Any]] | None = None
    two_part: list[dict[str, Any]] | None = None
    notes: list[str] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def permissions(provenance: str, features: Sequence[str] = (), registry: set[str] = ATTRIBUTION) -> tuple[str, str, str]:
    """(license, claim scope, output mode); what is not known takes the floor of all three."""
    known = provenance in MODES
    mode = MODES.get(provenance, STRICTEST)
    if not known or provenance in UNVERIFIABLE:
        return "DESCRIPTIVE_ONLY", "CONDITIONING_UNVERIFIABLE", mode
    scope = "SUBSTRATE_CIRCULAR" if set(features) & registry else "EXTERNAL_STRUCTURE" if provenance == "EXTERNAL" else "INTERNAL_DECOMPOSITION"
    return LICENSES.get(provenance, "DESCRIPTIVE_ONLY"), scope, mode


def estimator_named(name: str) -> str:
    if name in CAPABILITY:
        return name
    if name not in ESTIMATORS:
        raise Refusal(f"no estimator {name}; there are {sorted({*ESTIMATORS, *CAPABILITY})}")
    return ESTIMATORS[name]


def universe(hits: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """region_id, chrom, start, end, block, searched, n_used, mass of each region; rows of one region must agree."""
    if block_size < 1:
        raise Refusal("a block has at least one base")
    out = hits.groupBy("region_id").agg(
        F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.min("end").alias("end"), F.max((F.col("missingness") != "not_searched").cast("int")).alias("searched"),
        F.count_if(F.col("missingness") == "used").alias("n_used"), F.sum(F.abs("hit_coefficient")).alias("mass"),
        ((F.min("chrom") != F.max("chrom")) | (F.min("start") != F.max("start")) | (F.min("end") != F.max("end"))).alias("torn"),
        (F.count_if(F.col("missingness") == "not_searched").between(1, F.count("*") - 1)).alias("mixed"),
    )
    out = written(out, "universe")
    bad = out.filter("torn OR mixed").select("region_id", "torn").limit(1).collect()
    if bad:
        raise Refusal(f"region {bad[0].region_id}: " + ("rows disagree on where it lies" if bad[0].torn else "searched in one row and not in another"))
    return out.drop("torn", "mixed").withColumn("block", F.concat_ws(":", "chrom", F.floor(F.col("start") / block_size).cast("string")))


def region_family(hits: DataFrame) -> DataFrame:
    """region_id, family, n_hits, signed, mass of each family that was looked for in a region; an unnamed family is no family."""
    used = F.col("missingness") == "used"
    return hits.filter((F.col("missingness") != "not_searched") & F.col("family_id").isNotNull()).groupBy("region_id", F.col("family_id").alias("family")).agg(
        F.count_if(used).alias("n_hits"), F.coalesce(F.sum("hit_coefficient"), F.lit(0.0)).alias("signed"), F.coalesce(F.sum(F.abs("hit_coefficient")), F.lit(0.0)).alias("mass"))


def _health(row, floors: Floors) -> dict[str, Any]:
    out = {"n_submitted": row.submitted, "n_in_universe": row.found, "n_searched": row.searched, "n_blocks": row.blocks}
    out["intersection_coverage"] = row.found / row.submitted if row.submitted else None
    out["explained_fraction"] = row.explained / row.searched if row.searched else None
    fails = lambda x, least: x is None or x < least
    checks = (("intersection_coverage", floors.coverage), ("n_blocks", floors.blocks), ("explained_fraction", floors.explained))
    out["floor_failures"] = [f"{k}={out[k]} < floor {least}" for k, least in checks if fails(out[k], least)]
    return out


def interpret(hits: DataFrame, query: Query, floors: Floors = Floors(), block_size: int = BLOCK, n_bootstrap: int = REPLICATES, seed: int = 0, estimator: str = "percentile", usage: tuple[str, float] | str | None = None, log=None) -> Reading:
    """Answer a query at the strength that its provenance licenses.

    Order: parameters, license, table, held-out half, health, composition, effects, guards.  A failed floor of the query's
    own side keeps back everything but health; one of the comparator's side, the effects.  ``usage`` adds the two-part
    summary: "any_hit", ("contribution_floor", mass) or ("budget_fraction", share).
    """
    estimator = estimator_named(estimator)
    if n_bootstrap < LEAST_REPLICATES:
        raise Refusal(f"{n_bootstrap} replicates are below {LEAST_REPLICATES}")
    if query.provenance == "PROGRAMMATIC_RULE" and not (query.rule or "").strip():
        raise Refusal("a programmatic rule is written down")
    license, scope, mode = permissions(query.provenance, query.features)
    out = Reading(query.query_id, query.provenance, license, scope, mode, estimator, CAPABILITY[estimator], block_size, n_bootstrap, seed, query.comparator_id)
    hits = check_hits(hits)
    out.substrate_id, out.lexicon_id, out.input_scale = hits.select("substrate_id", "lexicon_id", "input_scale").first()
    if query.provenance not in MODES or query.provenance in UNVERIFIABLE:
        out.notes.append("what was seen when the regions were chosen cannot be verified")
    if scope == "SUBSTRATE_CIRCULAR":
        out.notes.append(f"the regions were chosen by {', '.join(sorted(set(query.features) & ATTRIBUTION))}, of the same surface as these numbers")
    unnamed = hits.filter((F.col("missingness") != "not_searched") & F.col("family_id").isNull()).count()
    if unnamed:
        out.notes.append(f"{unnamed} measured rows name no family: a gap in the naming, not a measured zero")
    ids = lambda df: df.select(F.col("region_id").cast("string").alias("region_id")).filter("region_id IS NOT NULL").distinct()
    sides = {"F": ids(query.regions), "O": ids(query.comparator) if query.comparator is not None else ids(query.regions).limit(0)}
    if license == "HELD_OUT_INFERENCE":
        if query.held_out is None or not query.held_out.take(1):
            raise Refusal("a split without its held-out half")
        kept = {s: df.join(ids(query.held_out), "region_id", "left_semi") for s, df in sides.items()}
        if kept["F"].take(1) and sides["O"].take(1) and not kept["O"].take(1):
            raise Refusal("the held-out half holds no region of the comparator")
        sides = kept
        out.notes.append("both sides are restricted to the held-out half")
    asked = sides["F"].withColumn("side", F.lit("F")).unionAll(sides["O"].withColumn("side", F.lit("O")))
    regions = universe(hits, block_size)
    sided = written(asked.join(regions, "region_id", "left"), "reading-regions")
    try:
        return _read(out, hits, query, floors, sided, usage, log)
    finally:
        discard(sided)


def _read(out: Reading, hits: DataFrame, query: Query, floors: Floors, sided: DataFrame, usage, log) -> Reading:
    on = F.col("searched") == 1
    per = {r.side: r for r in sided.groupBy("side").agg(
        F.count("*").alias("submitted"), F.count("chrom").alias("found"), F.count_if(on).alias("searched"), F.count_distinct(F.when(on, F.col("block"))).alias("blocks"), F.count_if(on & (F.col("n_used") > 0)).alias("explained")).collect()}
    if "F" not in per:
        raise Refusal(f"{query.query_id}: no regions, so no ratio has a denominator")
    out.health = _health(per["F"], floors)
    out.comparator_health = _health(per["O"], floors) if "O" in per else None
    blocks = sided.filter(on).groupBy("block").agg(F.bool_or(F.col("side") == "F").alias("q"), F.bool_or(F.col("side") == "O").alias("c"))
    both = blocks.agg(F.count("*").alias("union_blocks"), F.count_if(F.col("q") & F.col("c")).alias("shared_blocks")).first()
    shared = sided.groupBy("region_id").agg(F.count_distinct("side").alias("n")).filter("n > 1").count()
    out.contrast = {"union_blocks": both.union_blocks, "shared_blocks": both.shared_blocks, "shared_regions": shared}
    if out.health["floor_failures"]:
        out.floor_failures = [f"query: {x}" for x in out.health["floor_failures"]]
        out.suppression = "reading suppressed: " + "; ".join(out.floor_failures)
    else:
        rf = region_family(hits).join(sided.filter(on).select("region_id", "side", "block"), "region_id")
        held = {"peaks": sided.filter("chrom IS NOT NULL"), "rf": written(rf, "reading-families")}
        out.composition = sorted((r.asDict() for r in C.over("family_composition", held).collect()), key=lambda r: (-r["mean_coefficient"], r["family"]))
        out.emitted_order.append("composition")
        if out.statistical_license != "DESCRIPTIVE_ONLY":
            _effects(out, query, held, usage)
        discard(*[df for n, df in held.items() if n != "peaks"])
    found = [single_scale(hits), health_before_effect({"health": out.health, "floor_failures": [x for x in out.floor_failures if x.startswith("query")], "effects": out.effects, "interpretation_emitted": bool(out.composition), "emitted_order": out.emitted_order})]
    spark = hits.sparkSession
    found.append(selection_provenance_declared(spark.createDataFrame([(out.query_id, out.selection_provenance, out.output_mode)], "query_id string, selection_provenance string, output_mode string")))
    if out.effects:
        found.append(comparator_declared(spark.createDataFrame([(e["id"], e["comparator_id"]) for e in out.effects], "id string, comparator_id string")))
    require(found, log, f"the reading of {out.query_id}")
    return out


def _effects(out: Reading, query: Query, held: dict[str, DataFrame], usage) -> None:
    if query.comparator_id == MISSING or out.comparator_health is None:
        raise Refusal("an effect needs a named comparator; no baseline, no number")
    if out.contrast["shared_regions"]:
        raise Refusal(f"{out.contrast['shared_regions']} regions are on both sides")
    if out.comparator_health["floor_failures"]:
        out.floor_failures = [f"comparator: {x}" for x in out.comparator_health["floor_failures"]]
        out.suppression = "effects suppressed: " + "; ".join(out.floor_failures)
        return
    how = {"replicates": out.n_bootstrap, "seed": out.random_seed}
    test = out.estimator == "wild_cluster_bootstrap_t"
    rows = bca_intervals(C.over("bca_parts", held, **how)) if out.estimator != "percentile_block_bootstrap" else C.over("effect_ci_percentile", held, **how)
    p = {r.family: r for r in C.over("wild_t_pvalue", held, **how).collect()} if test else {}
    q = {r.family: r.q_value for r in C.over("bh_qvalues", held, **how).collect()} if test else {}
    out.effects = []
    for r in sorted(rows.collect(), key=lambda r: r.family):
        if r.status != "ESTIMATED" or (test and p[r.family].status != "TESTED"):
            raise Refusal(f"{r.family}: too few blocks or replicates stand behind its interval")
        out.effects.append({
            "id": f"{out.query_id}:{r.family}", "family_id": r.family, "comparator_id": out.comparator_id, "is_cross_condition": True, "effect": r.effect, "ci_low": r.ci_low, "ci_high": r.ci_high,
            "p_value": p[r.family].p_value if test else None, "q_value": q.get(r.family), "inference_capability": out.inference_capability, "estimator": out.estimator,
            "n_query_peaks": out.health["n_searched"], "n_comparator_peaks": out.comparator_health["n_searched"], "n_blocks": out.contrast["union_blocks"], "n_bootstrap": out.n_bootstrap, "n_bootstrap_valid": r.n_replicates,
            "block_size": out.block_size, "random_seed": out.random_seed, "estimator_min_blocks": 30 if out.estimator != "percentile_block_bootstrap" else None,
        })
    out.emitted_order.append("effects")
    if usage is not None:
        name, value = (usage, None) if isinstance(usage, str) else usage
        if name not in ("any_hit", "contribution_floor", "budget_fraction") or (value is None) != (name == "any_hit"):
            raise Refusal(f"no usage {usage}")
        if name == "budget_fraction" and held["rf"].groupBy("region_id").agg(F.sum("mass").alias("m"), F.sum("n_hits").alias("n")).filter("n > 0 AND m = 0").take(1):
            raise Refusal("a region with hits and no mass has no share")
        given = {"contribution_floor": {"floor_mass": value}, "budget_fraction": {"budget_share": value}}.get(name, {})
        out.two_part = sorted((r.asDict() for r in C.over(f"two_part_{name}", held, **given).collect()), key=lambda r: r["family"])
        out.emitted_order.append("two_part_effects")
