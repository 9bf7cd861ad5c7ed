"""Artifacts: typed tables and small text files, staged beside their place and renamed, so that none is seen half written.

Tables that grow with the data are written by Spark; text files hold what fits a driver (rows of families, cells, guards).
"""

from __future__ import annotations

import contextlib
import csv
import ctypes
import datetime
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import cell_text, digest, file_digest, markdown_text
from .publish import publish
from .readers import Refusal

# Columns of the flat files.
EFFECTS = ("id", "family_id", "comparator_id", "is_cross_condition", "effect", "ci_low", "ci_high", "p_value", "q_value", "inference_capability", "estimator", "n_query_peaks", "n_comparator_peaks", "n_blocks", "n_bootstrap", "n_bootstrap_valid",
           "block_size", "random_seed", "substrate_id", "lexicon_id", "input_scale", "statistical_license", "claim_scope", "estimator_min_blocks")
NULLS = ("source_node_id", "target_node_id", "null_shuffles", "seed", "empirical_p_value", "null_mean", "null_min", "null_max", "observed_ppm_similarity", "registration_rule_version")
EXCLUDED = ("source_node_id", "target_node_id", "exclusion_reason", "source_node_status", "target_node_status", "source_core_bp", "target_core_bp")
EDGES = {
    "source_node_id": "string", "target_node_id": "string", "orientation": "string", "offset": "long", "overlap_bp": "long", "overlap_frac_source": "double", "overlap_frac_target": "double", "ppm_similarity": "double",
    "signed_cwm_similarity": "double", "empirical_p_value": "double", "null_shuffles": "long", "seed": "long", "registered_on": "string", "registration_rule_version": "string",
}
STATUSES = ("RUNNING", "COMPLETED", "REFUSED", "CRASHED")


def _put(path: Path, text: str) -> Path:
    """Write text to a sibling and rename it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, path)
    return path


def put_json(path: str | Path, tree: Any) -> Path:
    """Sorted keys and a line end, so equal content is equal bytes."""
    return _put(Path(path), json.dumps(tree, indent=2, sort_keys=True, allow_nan=False, ensure_ascii=False) + "\n")


def put_tsv(path: str | Path, columns: Sequence[str], rows: Iterable[Mapping[str, Any]]) -> Path:
    """A header even without rows; absent cells are NA, tabs and line ends inside cells are blanks."""
    return _put(Path(path), "".join("\t".join(cell_text(x) for x in r) + "\n" for r in [columns, *([row.get(c) for c in columns] for row in rows)]))


@contextlib.contextmanager
def published(folder: str | Path) -> Iterator[Path]:
    """A folder made beside its place; it appears there whole, and never over another one."""
    folder = Path(folder)
    folder.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{folder.name}-", dir=folder.parent))
    try:
        yield stage
        rename_new(stage, folder)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def rename_new(source: Path, target: Path) -> None:
    """Rename that refuses an existing target, as one step where the system has it."""
    flag, here = 1, -100  # RENAME_NOREPLACE, AT_FDCWD
    call = getattr(ctypes.CDLL(None, use_errno=True), "renameat2", None)
    if call is not None and call(here, os.fsencode(source), here, os.fsencode(target), flag) == 0:
        return
    if target.exists() or (call is not None and ctypes.get_errno() == 17):
        raise Refusal(f"{target} is there already")
    os.rename(source, target)


def write_edges(edges: DataFrame, path: str, meta: Mapping[str, Any] | None = None) -> None:
    """Typed alignment edges in pair order (K01), published as one; an empty table keeps its types."""
    df = edges.select(*[F.col(c).cast(t).alias(c) for c, t in EDGES.items()])
    publish(df.repartitionByRange("source_node_id", "target_node_id").sortWithinPartitions("source_node_id", "target_node_id"), path, {"schema_version": "1", **(meta or {})})


def write_table(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """A distributed tab-separated table with a header in each part (K02, K03), published as one."""
    flat = df.select(*[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " "), F.lit("NA")).alias(c) for c in columns])
    publish(flat.repartitionByRange(*order).sortWithinPartitions(*order), path, write=lambda w, at: w.option("sep", "\t").option("header", True).option("quote", "").csv(at))


def write_registry(folder: str, meta: Mapping[str, Any], nodes: DataFrame, matrices: DataFrame) -> None:
    """registry.json, nodes.json and matrices.parquet."""
    nodes.write.json(f"{folder}/nodes.json")
    matrices.write.parquet(f"{folder}/matrices.parquet")
    put_json(Path(folder, "registry.json"), {"schema_version": "1", **meta})


def write_annotation(folder: str, candidates: DataFrame, backends: Sequence[Mapping[str, Any]]) -> None:
    """Candidates and the log of what each backend said."""
    publish(candidates.withColumn("schema_version", F.lit("1")), f"{folder}/annotation_candidates.parquet", {"schema_version": "1", "backends": [b.get("backend") or b.get("name") for b in backends]})
    put_json(Path(folder, "annotation_backends.json"), list(backends))


def write_decisions(folder: str, decisions: DataFrame, provenance: Mapping[str, Any]) -> str:
    """ontology_decisions.parquet, merge_decisions.json with its identity, and review.yaml of what needs a person."""
    import yaml

    rows = sorted((r.asDict(recursive=True) for r in decisions.collect()), key=lambda r: r["cluster_id"])  # considered clusters, as many as a person can review
    identity = digest({"decisions": rows})
    publish(decisions.withColumn("schema_version", F.lit("1")), f"{folder}/ontology_decisions.parquet", {"schema_version": "1", "artifact_id": identity, "provenance": dict(provenance)})
    put_json(Path(folder, "merge_decisions.json"), {"artifact_id": identity, "decisions": rows, "provenance": dict(provenance)})
    _put(Path(folder, "review.yaml"), yaml.safe_dump([r for r in rows if r["decision"] != "collapse"], sort_keys=True))
    return identity


def write_lexicon(folder: str | Path, tiers: Mapping[str, Mapping[str, Any]], operations: Sequence[Mapping[str, Any]]) -> None:
    """Every tier's members and manifest, an index, and the log of combinations, published together."""
    with published(folder) as stage:
        for tier, t in tiers.items():
            members = put_json(stage / f"{tier}.members.json", t["members"])
            order = [f"{m['tag']}.{m['pattern']}" for m in t["members"]]
            put_json(stage / f"{tier}.manifest.json", {**t["manifest"], "tier": tier, "n_motifs": len(order), "pattern_order": order, "members_file": members.name, "members_sha256": file_digest(members)})
        put_tsv(stage / "manifest.tsv", ("tier", "place", "tag", "pattern", "node_id", "variant_id"), ({"tier": tier, "place": i, **m} for tier, t in tiers.items() for i, m in enumerate(t["members"])))
        put_json(stage / "combination_operations.json", list(operations))


def write_stability(folder: str | Path, results: Sequence[Mapping[str, Any]], verification: Mapping[str, Any]) -> None:
    """Results with their ids and what was verified, never over an earlier publication."""
    with published(folder) as stage:
        put_json(stage / "stability_results.json", [{**r, "result_id": digest(r)} for r in results])
        put_json(stage / "backend_verification.json", dict(verification))


def write_effects(path: str | Path, reading) -> Path:
    """effect_estimates.tsv (K11): what an estimator may not say is NA, never 0 or blank."""
    shared = {k: getattr(reading, k) for k in ("substrate_id", "lexicon_id", "input_scale", "statistical_license", "claim_scope")}
    return put_tsv(path, EFFECTS, ({**e, **shared} for e in reading.effects or ()))


class Provenance:
    """Who ran what on which inputs (K15): appended to a log that is never overwritten."""

    def __init__(self, stage: str, out: str | Path, command: Sequence[str] = (), seed: int | None = None):
        self.path = Path(out, "provenance.json")
        self.record = {"stage": stage, "command": list(command), "seed": seed, "inputs": {}, "started": datetime.datetime.now(datetime.UTC).isoformat()}

    def add_input(self, role: str, path: str | Path) -> None:
        self.record["inputs"][role] = {"path": Path(path).name, "sha256": file_digest(path)}

    def write(self) -> Path:
        return put_json(self.path, [*_log(self.path), self.record])


def _log(path: Path) -> list:
    """What an append log holds; an unreadable one is put aside under another name, not lost."""
    if not path.exists():
        return []
    try:
        held = json.loads(path.read_text(encoding="utf-8"))
        if isinstance(held, list):
            return held
    except ValueError:
        pass
    os.replace(path, path.with_name(f"{path.name}.unreadable-{uuid.uuid4().hex[:8]}"))
    return []


class GuardLog:
    """Verdicts of a run (K16), each written before a refusal can end it."""

    def __init__(self, stage: str, out: str | Path | None = None):
        self.stage, self.path, self.held = stage, Path(out, "guard_outcomes.json") if out else None, []

    def record(self, verdict, subject: str) -> None:
        row = {"stage": self.stage, "guard_id": verdict.guard, "passed": verdict.passed, "detail": verdict.detail, "subject": subject, "at": datetime.datetime.now(datetime.UTC).isoformat()}
        self.held.append(row)
        if self.path:
            put_json(self.path, [*_log(self.path), row])


def guards_of_run(outcomes: Sequence[Mapping[str, Any]], runs: int) -> tuple[list, list]:
    """Outcomes of the last run and of earlier ones, by the number of provenance records at each."""
    last = [o for o in outcomes if o.get("provenance_records") == runs]
    return last, [o for o in outcomes if o.get("provenance_records") != runs]


def write_status(out: str | Path, status: str, command: Sequence[str], **more) -> Path:
    """run_status.json (K17); the start of a run is carried on to its end."""
    if status not in STATUSES:
        raise Refusal(f"no status {status}")
    path, now = Path(out, "run_status.json"), datetime.datetime.now(datetime.UTC).isoformat()
    before = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    started = before.get("started") if before.get("status") == "RUNNING" else None
    return put_json(path, {"status": status, "command": list(command), "started": started or now, "ended": None if status == "RUNNING" else now, **more})


def write_grid(folder: str | Path, tables: Mapping[str, tuple[Sequence[str], Sequence[Mapping[str, Any]]]], manifest: Mapping[str, Any], curve: str) -> None:
    """Tables of a specification grid as TSV, its manifest and the curve."""
    for name, (columns, rows) in tables.items():
        put_tsv(Path(folder, f"{name}.tsv"), columns, rows)
    put_json(Path(folder, "multiverse_manifest.json"), dict(manifest))
    _put(Path(folder, "specification_curve.md"), curve)


def table_text(columns: Sequence[str], rows: Iterable[Mapping[str, Any]]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(markdown_text(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def curve_text(summaries: Sequence[Mapping[str, Any]], cells: Sequence[Mapping[str, Any]], estimands: Sequence[Mapping[str, Any]]) -> str:
    """Specification curve as Markdown (K13), a section for each estimand; summaries are found by the id that the cells carry."""
    out = ["# Specification curve\n", table_text(("status", "n"), [{"status": s, "n": sum(c["status"] == s for c in cells)} for s in sorted({c["status"] for c in cells})])]
    for e in estimands:
        own = [s for s in summaries if s["estimand_id"] == e["estimand_id"]]
        out += [f"\n## {markdown_text(e.get('label') or e['query_id'])} ({e['estimand_id']})\n", table_text(("family_id", "n_cells", "sign_agreement", "minimum", "median", "maximum"), own) if own else "No cell of this estimand gave an estimate.\n"]
    return "\n".join(out)


def report_text(reading: Mapping[str, Any], provenance: Sequence[Mapping[str, Any]] = (), ledger: Sequence[Sequence[str]] = (), guards: tuple[str, Any] = ("ABSENT", None)) -> str:
    """Audit report as Markdown (K14): twelve sections, in which nothing is computed anew."""
    def flat(d):
        return table_text(("field", "value"), [{"field": k, "value": v} for k, v in (d or {}).items()]) if d else "None.\n"

    rows = lambda x, empty="None reported.\n": table_text(list(x[0]), x) if x else empty
    state, outcomes = guards
    said = {"ABSENT": "No guard record was written; that is not evidence that none ran.\n", "UNREADABLE": f"The guard record cannot be read: {outcomes}\n"}.get(state) or rows(list(outcomes), "The record is empty.\n")
    sections = {
        "Query": flat({k: reading.get(k) for k in ("query_id", "selection_provenance", "comparator_id")}), "License": flat({k: reading.get(k) for k in ("statistical_license", "claim_scope", "output_mode")}),
        "Substrate": flat({k: reading.get(k) for k in ("substrate_id", "lexicon_id", "input_scale")}), "Health of the query": flat(reading.get("health")), "Health of the comparator": flat(reading.get("comparator_health")),
        "Suppression": f"{reading.get('suppression') or 'Nothing was kept back.'}\n", "Composition": rows(reading.get("composition")), "Effects": rows(reading.get("effects")), "Bias ledger": rows([{str(i): x for i, x in enumerate(r)} for r in ledger]),
        "Guards": said, "Notes": "".join(f"- {n}\n" for n in reading.get("notes") or ()) or "None.\n", "Provenance": rows([{k: p.get(k) for k in ("stage", "command", "seed", "inputs", "started")} for p in provenance]),
    }
    return "# Audit report\n" + "".join(f"\n## {i}. {name}\n\n{text}" for i, (name, text) in enumerate(sections.items(), 1))


def write_report(path: str | Path, *args, **how) -> Path:
    return _put(Path(path), report_text(*args, **how))


def read_tsv(path: str | Path) -> list[dict[str, str]]:
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE))
