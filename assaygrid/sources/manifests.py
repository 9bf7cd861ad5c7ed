"""Small declared inputs, read on the driver: projects, manifests, ledgers, splits, decisions, designs, status files.

Every reader names what is missing or unknown and refuses; what grows with the data is returned as a DataFrame.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import MISSING, digest, file_digest, require_digest, substrate_id
from .readers import Refusal

ANALYSIS = ("id", "model", "readout", "union_id", "context", "modisco_h5")  # fixed values: fields of an analysis
ROLES = ("DISCOVERY", "ADJUDICATION", "VALIDATION", "INFERENCE")
OLD_LAYOUT = "metacluster_idx_to_submetacluster_results"
SUBSTRATE = {"schema_version", "substrate_id", "peak_universe_hash", "n_regions", "caller_specification"}
LEDGER = {"schema_version", "substrate_id", "n_opportunities", "n_searched", "n_retained"}


def _tree(path: str | Path) -> Any:
    """JSON, or YAML by its suffix."""
    p = Path(path)
    try:
        text = p.read_text(encoding="utf-8")
        if p.suffix in (".yaml", ".yml"):
            import yaml

            return yaml.safe_load(text)
        return json.loads(text)
    except (OSError, ValueError) as error:
        raise Refusal(f"{path} cannot be read: {error}") from error


def _exact(path: Any, tree: Any, keys: set[str]) -> dict:
    if not isinstance(tree, Mapping) or set(tree) != keys:
        got = set(tree) if isinstance(tree, Mapping) else {type(tree).__name__}
        raise Refusal(f"{path}: missing {sorted(keys - got)}, unknown {sorted(got - keys)}")
    return dict(tree)


def read_project(path: str | Path) -> dict[str, Any]:
    """A project (S06): every analysis declares all its fields, and unions are plain names."""
    tree = _tree(path)
    if not isinstance(tree, Mapping) or not tree.get("analyses"):
        raise Refusal(f"{path}: a project is a mapping with analyses")
    for a in tree["analyses"]:
        missing = [f for f in ANALYSIS if not a.get(f)]
        if missing or not re.fullmatch(r"[A-Za-z0-9]+", str(a["union_id"])):
            raise Refusal(f"{path}: analysis {a.get('id')}: missing {missing} or a union_id that is no plain name")
    return {"project": "unnamed-project", "peak_universe_id": MISSING, "shared_attribution_groups": None, **tree}


def attribution_sources(ids: Sequence[str], groups: Mapping[str, Sequence[str]] | None) -> int | None:
    """Independent attribution surfaces: shared groups count once, the rest each; undeclared is not known."""
    if groups is None:
        return None
    of: dict[str, str] = {}
    for g, members in groups.items():
        for m in members:
            if m in of or m not in ids:
                raise Refusal(f"{m} is in two groups or in no analysis")
            of[m] = g
    return len({("group", of[i]) if i in of else ("alone", i) for i in ids})


def cross_model_restricted(project: Mapping[str, Any]) -> bool:
    """Fewer than three distinct models carry no claim across models."""
    return len({a["model"] for a in project["analyses"]}) < 3


def metacluster_state(searched: bool, exists: bool, n: int) -> str:
    """Three absences kept apart."""
    return "NOT_SEARCHED" if not searched else "GROUP_ABSENT" if not exists else "PRESENT" if n else "GROUP_EMPTY"


def seqlet_count(pattern: Mapping[str, Any]) -> int | None:
    """Declared, or the length of what lists them."""
    seqlets = pattern.get("seqlets")
    if seqlets is None:
        return None
    if "n_seqlets" in seqlets:
        return int(seqlets["n_seqlets"])
    return next((len(seqlets[k]) for k in ("start", "example_idx") if k in seqlets), None)


def check_layout(keys: Sequence[str], name: str) -> None:
    """The old layout of discovery files is refused, not read as two empty groups."""
    if OLD_LAYOUT in keys:
        raise Refusal(f"{name}: the old discovery layout; convert it to pos_patterns and neg_patterns")


def read_patterns(path: str, analysis: str) -> list[dict[str, Any]]:
    """Patterns of a discovery HDF5 file (S07), in sorted order of their names; needs h5py, which is optional."""
    try:
        import h5py
    except ImportError as error:
        raise Refusal(f"{path}: reading HDF5 needs h5py; give the patterns as a Parquet table instead") from error
    out = []
    with h5py.File(path) as f:
        check_layout(list(f), analysis)
        for group, metacluster in (("pos_patterns", "pos"), ("neg_patterns", "neg")):
            for name in sorted(f[group]) if group in f else ():
                p = f[group][name]
                seqlets = {k: (v[()] if k == "n_seqlets" else range(len(v))) for k, v in p["seqlets"].items()} if "seqlets" in p else None
                out.append({"analysis": analysis, "metacluster": metacluster, "pattern": name, "seqlet_count": seqlet_count({"seqlets": seqlets}), **{k: [float(x) for x in p[s][()].ravel()] for k, s in (("cwm", "contrib_scores"), ("hypothetical_cwm", "hypothetical_contribs"), ("ppm", "sequence"))}})
    return out


def read_registry(spark: SparkSession, folder: str) -> tuple[dict[str, Any], DataFrame, DataFrame]:
    """Registry (S09, S14): meta of a supported version, nodes, matrices (node_id, kind, mat)."""
    meta = _tree(Path(folder, "registry.json"))
    if str(meta.get("schema_version")) != "1":
        raise Refusal(f"{folder}: schema_version {meta.get('schema_version')}")
    nodes = spark.read.schema("node_id string, model string, readout string, context string, metacluster string, union_id string, variant_id string, variant_assignment_source string, family_id string, denovo_pattern_id string, discovery_tier string, analysis_tier string, tier_reason string, core_start int, core_end int, seqlet_count long, core_ic double, motif_completeness double").json(f"{folder}/nodes.json")
    if nodes.groupBy("node_id").count().filter("count > 1").take(1):
        raise Refusal(f"{folder}: a node twice")
    return meta, nodes, spark.read.schema("node_id string, kind string, mat array<array<double>>").parquet(f"{folder}/matrices.parquet")


def read_versioned(spark: SparkSession, path: str, schema: str, version: str = "1") -> DataFrame:
    """Parquet evidence (S13) with the declared columns and one schema_version."""
    raw = spark.read.parquet(path)
    names = [c.strip().split()[0] for c in schema.split(",")]
    missing = [c for c in [*names, "schema_version"] if c not in raw.columns]
    if missing:
        raise Refusal(f"{path}: missing columns {', '.join(missing)}")
    found = {r[0] for r in raw.select("schema_version").distinct().limit(3).collect()}
    if found - {version}:
        raise Refusal(f"{path}: schema_version {sorted(map(str, found))}")
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in (c.strip().split(" ", 1) for c in schema.split(","))])


@dataclass(frozen=True)
class Substrate:
    substrate_id: str
    peak_universe_hash: str
    n_regions: int
    caller_specification: dict[str, Any]


def read_substrate(path: str | Path) -> Substrate:
    """Substrate manifest (S17): exact keys, and an id that is its content's."""
    t = _exact(path, _tree(path), SUBSTRATE)
    own = substrate_id(t["peak_universe_hash"], t["n_regions"], t["caller_specification"], t["schema_version"])
    if own != require_digest("substrate_id", t["substrate_id"]):
        raise Refusal(f"{path}: substrate_id is not that of its content")
    return Substrate(own, t["peak_universe_hash"], int(t["n_regions"]), t["caller_specification"])


def read_ledger(path: str | Path, substrate: str | None = None) -> dict[str, Any]:
    """Opportunity ledger (S17): opportunities >= searched >= retained, of one substrate."""
    t = _exact(path, _tree(path), LEDGER)
    if not t["n_opportunities"] >= t["n_searched"] >= t["n_retained"] >= 0 or (substrate and t["substrate_id"] != substrate):
        raise Refusal(f"{path}: counts that do not nest, or another substrate")
    return t


def check_against(hits: DataFrame, substrate: Substrate, ledger: Mapping[str, Any] | None = None) -> None:
    """Distinct regions as the manifest says (A27), and the ledger's counts recounted."""
    r = hits.agg(F.count_distinct("region_id").alias("n"), F.count_if(F.col("missingness") == "used").alias("used"), F.count_if(F.col("missingness") != "not_searched").alias("searched"), F.count("*").alias("all"), F.max("substrate_id").alias("s"), F.min("substrate_id").alias("t")).first()
    if r.n != substrate.n_regions or {r.s, r.t} != {substrate.substrate_id}:
        raise Refusal(f"{r.n} regions of substrate {r.s}, not {substrate.n_regions} of {substrate.substrate_id}")
    if ledger and (r["all"], r.searched, r.used) != (ledger["n_opportunities"], ledger["n_searched"], ledger["n_retained"]):
        raise Refusal(f"counted {r['all']}, {r.searched}, {r.used}; the ledger has other figures")


def read_splits(spark: SparkSession, path: str | Path) -> DataFrame:
    """Split manifest (S18) as (peak_id, role); the checksum is that of the assignments."""
    t = _exact(path, _tree(path), {"schema_version", "assignments", "checksum"})
    roles = t["assignments"]
    if not roles or set(roles.values()) - set(ROLES) or digest({"assignments": roles}) != t["checksum"]:
        raise Refusal(f"{path}: no assignments, an unknown role, or another checksum")
    return spark.createDataFrame(sorted(roles.items()), "peak_id string, role string")


def read_artifact(path: str | Path, kind: str) -> dict[str, Any]:
    """Split artifact of a kind (S18), proven by its artifact_id."""
    t = _tree(path)
    if not isinstance(t, Mapping) or t.get("kind") != kind or t.get("artifact_id") != digest({k: v for k, v in t.items() if k != "artifact_id"}):
        raise Refusal(f"{path}: not a {kind} artifact, or another content than its id")
    return dict(t)


def read_decisions(spark: SparkSession, path: str | Path) -> DataFrame:
    """Decision bundle (S16): (cluster_id, decision, representative, member), proven by its artifact_id."""
    t = _tree(path)
    if not isinstance(t, Mapping) or t.get("artifact_id") != digest({"decisions": t.get("decisions")}):
        raise Refusal(f"{path}: the decisions are not those of its artifact_id")
    rows = [(d["cluster_id"], d["decision"], d.get("representative"), list(d["members"]), d.get("merge_confidence"), bool(d.get("family_ambiguity")), bool(d.get("threshold_sensitive"))) for d in t["decisions"]]
    if len({r[0] for r in rows}) != len(rows) or any(r[1] == "collapse" and r[2] not in r[3] for r in rows):
        raise Refusal(f"{path}: a cluster twice, or a representative that is no member")
    return spark.createDataFrame(rows, "cluster_id string, decision string, representative string, members array<string>, merge_confidence string, family_ambiguity boolean, threshold_sensitive boolean")


def read_matches(spark: SparkSession, path: str | Path, section: str) -> DataFrame:
    """Precomputed database matches (S10, S11): (node_id, source, source_version, matched_motif_id, q); a version is required."""
    t = (_tree(path) or {}).get(section)
    if not isinstance(t, Mapping):
        raise Refusal(f"{path}: no section {section}")
    if t.get("error"):
        raise Refusal(f"{section} is unverified: {t['error']}")
    if not str(t.get("version") or "").strip():
        raise Refusal(f"{path}: {section} names no version")
    rows = [(m["node_id"], section, str(t["version"]), m["matched_motif_id"], None if m.get("q") is None else float(m["q"])) for m in t.get("matches") or []]
    return spark.createDataFrame(rows, "node_id string, source string, source_version string, matched_motif_id string, q double")


def read_occurrence_null(spark: SparkSession, path: str | Path) -> DataFrame:
    """Occurrence nulls (S12) by candidate."""
    t = _tree(path)
    if not isinstance(t, Mapping):
        raise Refusal(f"{path}: a mapping of candidate ids")
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(t.items())], "candidate_id string, occurrence_null double")


def read_change_table(spark: SparkSession, path: str) -> DataFrame:
    """One side of a before/after comparison (S19), from Parquet or tab-separated text."""
    raw = spark.read.parquet(path) if not path.endswith(".tsv") else spark.read.option("sep", "\t").option("header", True).csv(path)
    need = {"peak_id": "string", "hit_id": "string", "coefficient": "double", "reconstruction": "double"}
    missing = [c for c in need if c not in raw.columns]
    if missing:
        raise Refusal(f"{path}: missing columns {', '.join(missing)}")
    return raw.select(*[F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in need.items()])


def read_caller_hits(spark: SparkSession, path: str) -> DataFrame:
    """A caller's own hits (S25), unique by (peak, motif, start, strand)."""
    df = spark.read.option("sep", "\t").option("header", True).schema("peak string, motif string, start long, strand string, coefficient double").csv(path)
    if df.groupBy("peak", "motif", "start", "strand").count().filter("count > 1").take(1):
        raise Refusal(f"{path}: a hit twice")
    return df


# Header and axes of a bias ledger.
BIAS_LEDGER, BIAS_AXES = ("axis_id", "bias", "mechanism", "control"), tuple(f"BA-{i:02d}" for i in range(1, 21))


def read_bias_ledger(path: str | Path, axes: Sequence[str], columns: Sequence[str]) -> list[list[str]]:
    """Bias ledger (S23), verbatim: this header and these axes, in this order."""
    with open(path, newline="", encoding="utf-8") as f:
        rows = [r for r in csv.reader(f, delimiter="\t") if r]
    if not rows or rows[0] != list(columns) or any(len(r) != len(columns) for r in rows) or [r[0] for r in rows[1:]] != list(axes):
        raise Refusal(f"{path}: not the declared header and axes")
    return rows[1:]


def read_record(path: str | Path) -> tuple[str, Any]:
    """A JSON artifact (S24) as (ABSENT, UNREADABLE or PRESENT, content): three different claims."""
    if not Path(path).exists():
        return "ABSENT", None
    try:
        return "PRESENT", _tree(path)
    except Refusal as error:
        return "UNREADABLE", str(error)


def read_lexicon(folder: str | Path, tier: str) -> dict[str, Any]:
    """Manifest of one compiled tier (S20); its table must hash to what the manifest says."""
    m = _tree(Path(folder, f"{tier}.manifest.json"))
    if m.get("tier") != tier or m["n_motifs"] != len(m["pattern_order"]) or file_digest(Path(folder, m["members_file"])) != m["members_sha256"]:
        raise Refusal(f"{folder}: {tier} is not what its manifest describes")
    return m


def read_lexicons(folder: str | Path, tiers: Sequence[str] = ("core", "expanded", "sensitivity")) -> dict[str, dict[str, Any]]:
    """All tiers and nothing else."""
    out = {t: read_lexicon(folder, t) for t in tiers}
    known = {f"{t}.manifest.json" for t in tiers} | {m["members_file"] for m in out.values()} | {"manifest.tsv", "combination_operations.json"}
    orphans = sorted(p.name for p in Path(folder).iterdir() if p.name not in known)
    if orphans:
        raise Refusal(f"{folder}: files of no tier: {orphans}")
    return out
