"""Command line: python -m assaygrid.cli SUBCOMMAND ... --out FOLDER.

Provenance is written before anything is computed and the status at the end; a refusal exits with 4, a crash with 1.
Tables are read and written by Spark, so paths of data can be anywhere Spark reads; small artifacts lie in the folder.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import IdentityError
from .operators import annotation, compiling, registration, validation, watch
from .operators.adjudication import adjudicate_all
from .operators.criteria import read_criteria
from .operators.design import histogram, run_design
from .operators.evidence import adjudicate_under
from .operators.guards import index_order_matches_loader, no_cross_model_cwm_avg, require
from .operators.reading import BLOCK, REPLICATES, Floors, Query, interpret
from .plans.engine import CATALOGUE
from .sources import manifests, sinks
from .sources.readers import Refusal, read_hits, read_regions
from .sources.scratch import written

REFUSED, CRASHED = 4, 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="assaygrid", description=__doc__)
    sub = top.add_subparsers(dest="stage", required=True)

    def add(name: str, what: str, *flags: tuple) -> None:
        p = sub.add_parser(name)
        p.add_argument(what)
        p.add_argument("--out", required=True)
        for flag, how in flags:
            p.add_argument(flag, **how)

    text, many, number = {"default": None}, {"action": "append", "default": []}, lambda kind, default: {"type": kind, "default": default}
    reading = (
        ("--peaks", {"required": True}), ("--comparator", text), ("--comparator-id", {"default": "NA"}), ("--selection-provenance", {"default": "DECLARATION_MISSING"}), ("--selection-rule", text), ("--selection-feature", many), ("--held-out", text),
        ("--estimator", {"default": "percentile"}), ("--block-size", number(int, BLOCK)), ("--bootstrap", number(int, REPLICATES)), ("--floor-coverage", number(float, 0.9)), ("--floor-blocks", number(int, 30)), ("--floor-explained", number(float, 0.5)),
        ("--seed", number(int, 0)), ("--substrate-manifest", text), ("--opportunity-ledger", text),
    )
    add("interpret", "hits", *reading)
    add("infer", "hits", *reading)
    add("ingest", "project")
    add("align", "registry", ("--null-shuffles", number(int, 1000)), ("--seed", number(int, 0)))
    add("annotate", "evidence", ("--registry", {"required": True}), ("--section", {"action": "append", "default": []}), ("--occurrence-null", text))
    add("adjudicate", "edges", ("--motifs", {"required": True}), ("--criteria", text), ("--candidates", text), ("--stability", text))
    add("compile", "registry", ("--decisions", {"required": True}), ("--tiers", text))
    add("validate", "before", ("--after", {"required": True}), ("--decision-id", {"required": True}))
    add("multiverse", "design")
    add("report", "interpretation", ("--bias-ledger", text))
    return top


def _ids(spark: SparkSession, path: str | None) -> DataFrame | None:
    return read_regions(spark, path) if path else None


def _reading(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    hits = read_hits(spark, a.hits)
    if a.substrate_manifest:
        s = manifests.read_substrate(a.substrate_manifest)
        manifests.check_against(hits, s, manifests.read_ledger(a.opportunity_ledger, s.substrate_id) if a.opportunity_ledger else None)
    q = Query(Path(a.peaks).stem, read_regions(spark, a.peaks), _ids(spark, a.comparator), a.comparator_id, a.selection_provenance, a.selection_rule, a.selection_feature, _ids(spark, a.held_out))
    r = interpret(hits, q, Floors(a.floor_coverage, a.floor_blocks, a.floor_explained), a.block_size, a.bootstrap, a.seed, a.estimator, log=log)
    if a.stage == "infer":
        if r.effects is None:
            raise Refusal(r.suppression or "no effect is licensed")
        sinks.write_effects(out / "effect_estimates.tsv", r)
    else:
        sinks.put_json(out / "interpretation.json", r.to_dict())
    first = sorted(r.effects or (), key=lambda e: (-e["effect"], e["family_id"]))[:5]
    return r.suppression or "\n".join([f"{len(r.effects or ())} effects", *(f"{e['family_id']} {e['effect']:.6g} [{e['ci_low']:.6g}, {e['ci_high']:.6g}]" for e in first)])


def _ingest(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    project = manifests.read_project(a.project)
    rows = [{**p, **{k: x[k] for k in ("model", "readout", "union_id", "context")}} for x in project["analyses"] for p in manifests.read_patterns(str(Path(a.project).parent / x["modisco_h5"]), x["id"])]
    df = spark.createDataFrame([(r["analysis"], r["union_id"], r["model"], r["readout"], r["context"], r["metacluster"], r["pattern"], r["seqlet_count"], r["cwm"], r["ppm"]) for r in rows], "analysis string, union_id string, model string, readout string, context string, metacluster string, pattern string, seqlet_count long, cwm array<double>, ppm array<double>")
    nodes = annotation.variant_counters(df).withColumns({"node_id": F.concat_ws("/", "analysis", "metacluster", "pattern"), "denovo_pattern_id": F.concat_ws("/", "analysis", "metacluster", "pattern"), "discovery_tier": F.lit("core"), "analysis_tier": F.lit("core")})
    mats = nodes.select("node_id", F.explode(F.create_map(F.lit("cwm"), F.col("cwm"), F.lit("ppm"), F.col("ppm"))).alias("kind", "flat"))
    mats = mats.select("node_id", "kind", F.transform(F.sequence(F.lit(0), (F.size("flat") / 4).cast("int") - 1), lambda i: F.slice("flat", i * 4 + 1, F.lit(4))).alias("mat"))
    sinks.write_registry(str(out), {"project": project["project"]}, nodes.drop("cwm", "ppm", "analysis", "pattern"), mats)
    return f"{len(rows)} patterns"


def _align(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    """Edges, null summary and excluded pairs; considered = edges + excluded, or no summary is written."""
    if a.null_shuffles < 1:
        raise Refusal(f"--null-shuffles is at least 1, not {a.null_shuffles}")
    _, nodes, mats = manifests.read_registry(spark, a.registry)
    cwm = mats.filter("kind = 'cwm'")
    declared = {"core_start", "core_end"} <= set(nodes.columns)
    if declared:  # a declared core is registered as it is; without one a motif is left out
        cwm, trim = cwm.join(nodes.select("node_id", "core_start", "core_end"), "node_id").select("node_id", F.col("mat").alias("whole"), annotation.declared_core().alias("mat")), 0.0
    else:
        cwm, trim = cwm.withColumn("whole", F.col("mat")), registration.TRIM
    flat = cwm.select("node_id", F.flatten("mat").alias("embedding"), F.col("whole").isNotNull().alias("has_matrix"))
    # a registry's nodes fit the driver; ids in their order become numbers, the smaller one the source
    order = spark.createDataFrame([(r.node_id, i) for i, r in enumerate(nodes.select("node_id").orderBy("node_id").collect())], "node_id string, node long")
    numbered = order.join(flat, "node_id", "left").select("node", "node_id", "embedding", F.coalesce("has_matrix", F.lit(False)).alias("has_matrix")).persist()
    pairs = registration.register(numbered.select("node", "embedding"), a.null_shuffles, a.seed, trim=trim)
    name = lambda c: numbered.select(F.col("node").alias(c), F.col("node_id").alias(f"{c}_node_id"))
    edges = pairs.join(name("source"), "source").join(name("target"), "target").withColumns({"registered_on": F.lit(registration.REGISTERED_ON), "registration_rule_version": F.lit(registration.RULE)})
    watched = watch.Watched(edges.drop("source", "target"), watch.unsigned())
    edges = written(watched.table, "edges")
    require(watched.verdicts(), log, "the edges about to be published")
    sinks.write_edges(edges, str(out / "alignment_edges.parquet"), {"null_shuffles": a.null_shuffles, "seed": a.seed, "registration_rule_version": registration.RULE})
    sinks.write_table(edges.withColumn("observed_ppm_similarity", F.col("ppm_similarity")), str(out / "alignment_null_summary.tsv"), sinks.NULLS, sinks.NULLS[:2])
    status = numbered.select("node", F.when(registration.usable(), "registrable").when(F.col("has_matrix") & F.col("embedding").isNull(), "no_declared_trimmed_core").otherwise("no_ppm_array").alias("status"), registration.core_bp(trim=trim).alias("core_bp"))
    held = {"motif_status": status}
    left = CATALOGUE.over("excluded_pairs", held).join(name("source"), "source").join(name("target"), "target")
    left = left.select("source_node_id", "target_node_id", F.col("exclusion").alias("exclusion_reason"), F.col("source_status").alias("source_node_status"), F.col("target_status").alias("target_node_status"), "source_core_bp", "target_core_bp")
    sinks.write_table(left, str(out / "alignment_excluded_pairs.tsv"), sinks.EXCLUDED, sinks.EXCLUDED[:2])
    counts = {(r.kind, r.reason): r.n for r in CATALOGUE.over("exclusion_histogram", held).collect()}
    n, found = numbered.count(), edges.count()
    considered, below = counts["pair", "considered"], counts["pair", "no_offset_meets_overlap_floor"]
    if found + counts["pair", "node_not_registrable"] + below != considered:
        raise Refusal(f"{found} edges and {considered - found} other pairs do not add up to what was counted from the lengths")
    sinks.put_json(out / "alignment_run_summary.json", {"n_nodes": n, "n_pairs_considered": considered, "n_edges": found, "n_pairs_excluded": considered - found, "n_pairs_excluded_by_reason": {"node_not_registrable": considered - found - below, "no_offset_meets_overlap_floor": below}, "null_shuffles": a.null_shuffles, "seed": a.seed, "registration_rule_version": registration.RULE})
    first = edges.orderBy("source_node_id", "target_node_id").limit(5).collect()
    return "\n".join([f"{found} of {considered} pairs", *(f"{r.source_node_id} {r.target_node_id} {r.orientation}{r.offset} {r.ppm_similarity:.3f}" for r in first)])


def _annotate(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    _, nodes, _ = manifests.read_registry(spark, a.registry)
    nodes = nodes.select("node_id", annotation.core_length().alias("core_length"), "seqlet_count")

    class Section:
        optional = True

        def __init__(self, name: str):
            self.name = name

        def annotate(self, _):
            return manifests.read_matches(spark, a.evidence, self.name)

    rows, backends = annotation.annotate(nodes, [Section(s) for s in a.section], manifests.read_occurrence_null(spark, a.occurrence_null) if a.occurrence_null else None)
    if rows is None:
        raise Refusal(f"no backend answered: {backends}")
    watched = watch.Watched(rows.join(nodes.select("node_id", F.col("core_length").alias("__core"), F.col("seqlet_count").alias("__seqlets")), "node_id", "left"), watch.weak_flags(core="__core", seqlets="__seqlets"))
    candidates = written(watched.table, "candidates").drop("__core", "__seqlets")
    require(watched.verdicts(), log, "the candidates about to be published")
    sinks.write_annotation(str(out), candidates, backends)
    return f"{len(backends)} backends"


def _adjudicate(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    """Under a file of criteria, with candidates and stability results where they are given; without one, by the declared duplicate rule."""
    edges, motifs = spark.read.parquet(a.edges), spark.read.parquet(a.motifs)
    if a.criteria:
        results = spark.read.option("multiLine", True).json(a.stability) if a.stability else None
        if results is not None and (missing := {"decision_id", "status", "n_affected_peaks"} - set(results.columns)):
            raise Refusal(f"{a.stability}: missing fields {', '.join(sorted(missing))}")
        found = adjudicate_under(read_criteria(a.criteria), edges, motifs, spark.read.parquet(a.candidates) if a.candidates else None, results).withColumn("reason", F.col("rationale"))
    elif a.candidates or a.stability:
        raise Refusal("candidates and stability are evidence of criteria; none are given")
    else:
        found = adjudicate_all(edges, motifs).withColumn("representative", F.col("medoid"))
    named = found.select(F.col("decision_id").alias("cluster_id"), "decision", F.col("representative").cast("string").alias("representative"), F.from_json("members", "array<string>").alias("members"), "relationship", "reason")
    if named.filter("members IS NULL").take(1):
        raise Refusal("a cluster of more members than a person can review")
    return sinks.write_decisions(str(out), named, {"edges": a.edges, **({"criteria": a.criteria} if a.criteria else {})})


def _compile(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    _, nodes, mats = manifests.read_registry(spark, a.registry)
    decisions = manifests.read_decisions(spark, a.decisions)
    if a.tiers:
        nodes = compiling.apply_tiers(nodes, spark.read.schema("node_id string, discovery_tier string, analysis_tier string, tier_reason string").json(a.tiers))
    ordered = {x: compiling.loading_order(compiling.members(nodes, decisions, x)).persist() for x in compiling.LEXICONS}
    done = {x: compiling.compiled(o, mats, {"trim_threshold": registration.TRIM}) for x, o in ordered.items()}
    # what became of each matrix is read off the numbers before they are published, and no mean may cross an axis
    cwm = mats.filter("kind = 'cwm'").select("node_id", "mat")
    ops = compiling.operations(cwm.join(ordered["expanded"], "node_id", "left_semi"), cwm, decisions, nodes).persist()
    found = [no_cross_model_cwm_avg(ops)]
    place = "row_number() OVER (ORDER BY tag DESC, place) - 1 AS place"
    for x, t in done.items():
        index = spark.createDataFrame([(i, m["node_id"]) for i, m in enumerate(t["members"])], "place long, name string")
        found.append(index_order_matches_loader(index, ordered[x].selectExpr(place, "node_id AS name")))
    require(found, log, "the lexicons about to be published")
    sinks.write_lexicon(out / "lexicons", done, [r.asDict(recursive=True) for r in ops.orderBy("id").collect()])  # one row for each motif of a lexicon, which fits the driver
    return ", ".join(f"{x}: {len(t['members'])}" for x, t in done.items())


def _validate(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    sides = [manifests.read_change_table(spark, p) for p in (a.before, a.after)]
    results, seen = validation.validate([validation.FrozenTables(*sides)], None, [a.decision_id])
    sinks.write_stability(out / "stability", results, {"backends": seen})
    return results[0]["status"]


def _multiverse(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    return str(histogram(run_design(spark, a.design, out)[0]))


def _report(spark: SparkSession, a: argparse.Namespace, out: Path, log: sinks.GuardLog) -> str:
    state, tree = manifests.read_record(a.interpretation)
    if state != "PRESENT":
        raise Refusal(f"{a.interpretation} is {state}")
    beside = Path(a.interpretation).parent
    past = manifests.read_record(beside / "provenance.json")
    ledger = manifests.read_bias_ledger(a.bias_ledger, manifests.BIAS_AXES, manifests.BIAS_LEDGER) if a.bias_ledger else []
    return str(sinks.write_report(out / "report.md", tree, past[1] if past[0] == "PRESENT" else (), ledger, manifests.read_record(beside / "guard_outcomes.json")))


STAGES = {"interpret": _reading, "infer": _reading, "ingest": _ingest, "align": _align, "annotate": _annotate, "adjudicate": _adjudicate, "compile": _compile, "validate": _validate, "multiverse": _multiverse, "report": _report}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    out, command = Path(a.out), [a.stage, *map(str, (argv or sys.argv[1:])[1:])]
    sinks.write_status(out, "RUNNING", command)
    record = sinks.Provenance(a.stage, out, command, getattr(a, "seed", None))
    for role, value in vars(a).items():
        if isinstance(value, str) and role not in ("stage", "out") and os.path.isfile(value):
            record.add_input(role, value)
    record.write()
    try:
        said = STAGES[a.stage](spark or SparkSession.builder.getOrCreate(), a, out, sinks.GuardLog(a.stage, out))
    except (Refusal, IdentityError) as error:
        sinks.write_status(out, "REFUSED", command, reason=str(error))
        print(f"refused: {error}", file=sys.stderr)
        return REFUSED
    except Exception as error:
        sinks.write_status(out, "CRASHED", command, reason=str(error).splitlines()[0] if str(error) else type(error).__name__)
        print(f"crashed: {error}", file=sys.stderr)
        return CRASHED
    sinks.write_status(out, "COMPLETED", command, said=said)
    print(said)
    return 0


if __name__ == "__main__":
    sys.exit(main())
