"""A specification grid: estimands x measurements x statistical choices, planned before it runs, summed up within estimands.

Cells are found again by ids over what a design declares and what its files hold.  Any exception of a cell is a row of
the result; a family that a cell could not look for is a row too, never a gap and never 0.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import file_digest, short_id
from ..sources.readers import Refusal, read_hits, read_regions
from ..sources.sinks import GuardLog, curve_text, write_grid
from .guards import GuardRefusal, no_cross_estimand_pooling
from .reading import BLOCK, REPLICATES, Floors, Query, Reading, interpret

# What becomes of a cell, and of a family in a cell.
SUCCESS, REFUSED_GUARD, REFUSED_SCHEMA, NOT_ESTIMABLE, ERROR = CELL = ("SUCCESS", "REFUSED_GUARD", "REFUSED_SCHEMA", "NOT_ESTIMABLE", "ERROR")
FAMILY = ("ESTIMATED", "MEASURED_ZERO", "NOT_IN_LEXICON", "NOT_SEARCHED", "NOT_ESTIMABLE", "CELL_REFUSED")
NOT_DECLARED = "NOT_DECLARED"


@dataclass(frozen=True)
class Estimand:
    query_id: str
    query_regions: str
    baseline_id: str
    baseline_population_type: str
    baseline_construction_rule: str
    baseline_regions: str
    selection_provenance: str
    selection_rule: str
    selection_feature_names: tuple[str, ...] = ()
    label: str = ""


@dataclass(frozen=True)
class Measurement:
    measurement_id: str
    lexicon_id: str
    substrate_id: str
    hit_table: str
    lexicon_content_hash: str
    lexicon_manifest: str = ""
    opportunity_ledger: str = ""
    label: str = ""


@dataclass(frozen=True)
class Choice:
    statistical_id: str
    estimator: str = "percentile"
    block_size: int = BLOCK
    n_bootstrap: int = REPLICATES
    seed: int = 0
    floor_coverage: float = 0.9
    floor_blocks: float = 30.0
    floor_explained: float = 0.5
    label: str = ""


@dataclass(frozen=True)
class Cell:
    cell_id: str
    estimand_id: str
    estimand: Estimand
    measurement: Measurement
    choice: Choice


@dataclass
class Outcome:
    cell: Cell
    status: str
    reason: str = ""
    reading: Reading | None = None
    families: set[str] = field(default_factory=set)
    searched: set[str] = field(default_factory=set)


def read_design(path: str | Path) -> tuple[dict[str, Any], list[Estimand], list[Measurement], list[Choice]]:
    """A design (S22); an unknown field is refused, and files lie beside the design."""
    try:
        tree = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise Refusal(f"{path} is no design: {error}") from error
    out = []
    for kind, key in ((Estimand, "estimands"), (Measurement, "measurements"), (Choice, "statistical_choices")):
        rows = tree.get(key) if isinstance(tree, Mapping) else None
        if not isinstance(rows, list) or not rows:
            raise Refusal(f"{path}: {key} is a list of objects")
        known = {f.name for f in fields(kind)}
        for r in rows:
            if not isinstance(r, Mapping) or set(r) - known:
                raise Refusal(f"{path}: {key} has unknown fields {sorted(set(r) - known) if isinstance(r, Mapping) else r}")
        try:
            out.append([kind(**{k: tuple(v) if k == "selection_feature_names" else v for k, v in r.items()}) for r in rows])
        except TypeError as error:
            raise Refusal(f"{path}: {key}: {error}") from error
    return {"root": str(Path(path).resolve().parent), "multiverse_id": tree.get("multiverse_id") or Path(path).stem}, *out


def specifications(root: str, estimands: Sequence[Estimand], measurements: Sequence[Measurement], choices: Sequence[Choice]) -> list[Cell]:
    """The product of the axes in order of declaration (J19); ids bind the contents of files, not their paths."""
    known: dict[str, str] = {"": NOT_DECLARED}

    def content(name: str) -> str:
        if name not in known:
            p = Path(root, name)
            known[name] = file_digest(p) if p.is_file() else short_id("folder", {f.name: file_digest(f) for f in sorted(p.rglob("*.parquet"))}) if p.is_dir() else NOT_DECLARED
        return known[name]

    out = []
    for e in estimands:
        own = {k: v for k, v in asdict(e).items() if k not in ("query_regions", "baseline_regions", "label")} | {"query": content(e.query_regions), "baseline": content(e.baseline_regions)}
        eid = short_id("estimand", own)
        for m in measurements:
            bound = {"measurement_id": m.measurement_id, "lexicon_id": m.lexicon_id, "substrate_id": m.substrate_id, "hash": m.lexicon_content_hash, "hits": content(m.hit_table), "manifest": content(m.lexicon_manifest), "ledger": content(m.opportunity_ledger)}
            out += [Cell(short_id("cell", {"estimand": eid, "measurement": bound, "choice": {k: v for k, v in asdict(c).items() if k != "label"}}), eid, e, m, c) for c in choices]
    if len({c.cell_id for c in out}) != len(out):
        raise Refusal("two cells of one id")
    return out


def run_cell(spark: SparkSession, root: str, cell: Cell, table: Callable[[str], DataFrame], log: GuardLog | None = None) -> Outcome:
    """One cell: the declared table, the declared sets, the declared choices; whatever goes wrong is its outcome."""
    e, m, c = cell.estimand, cell.measurement, cell.choice
    try:
        hits = table(m.hit_table)
        r = hits.select("lexicon_id", "substrate_id").distinct().limit(2).collect()
        if [tuple(x) for x in r] != [(m.lexicon_id, m.substrate_id)]:
            raise Refusal(f"{m.measurement_id} declares another lexicon or substrate than its table has")
        sets = [read_regions(spark, str(Path(root, p))) for p in (e.query_regions, e.baseline_regions)]
        measured = hits.filter((F.col("missingness") != "not_searched") & F.col("family_id").isNotNull()).select("region_id", "family_id")
        families = {x[0] for x in hits.filter("family_id IS NOT NULL").select("family_id").distinct().collect()}
        searched = {x[0] for x in measured.join(sets[0].select("region_id").unionAll(sets[1].select("region_id")).distinct(), "region_id", "left_semi").select("family_id").distinct().collect()}
    except Refusal as error:
        return Outcome(cell, REFUSED_SCHEMA, str(error))
    except Exception as error:
        return Outcome(cell, ERROR, str(error).splitlines()[0])
    out = Outcome(cell, ERROR, families=families, searched=searched)
    try:
        q = Query(e.query_id, sets[0], sets[1], e.baseline_id, e.selection_provenance, e.selection_rule, e.selection_feature_names)
        out.reading = interpret(hits, q, Floors(c.floor_coverage, int(c.floor_blocks), c.floor_explained), c.block_size, c.n_bootstrap, c.seed, c.estimator, log=log)
        out.status, out.reason = (SUCCESS, "") if out.reading.effects is not None else (NOT_ESTIMABLE, out.reading.suppression or "no effect is licensed")
    except Refusal as error:
        out.status, out.reason = (REFUSED_GUARD if isinstance(error, GuardRefusal) else REFUSED_SCHEMA), str(error)
    except Exception as error:
        out.reason = str(error).splitlines()[0]
    return out


def family_states(outcomes: Sequence[Outcome]) -> list[dict[str, Any]]:
    """One of six states for every cell and every family of any cell."""
    every = set().union(*(o.families for o in outcomes))
    rows = []
    for o in outcomes:
        effects = {e["family_id"]: e["effect"] for e in (o.reading.effects or ())} if o.reading else {}
        for f in sorted(every):
            v = effects.get(f)
            state = "CELL_REFUSED" if o.status != SUCCESS else "NOT_IN_LEXICON" if f not in o.families else "NOT_SEARCHED" if f not in o.searched else "NOT_ESTIMABLE" if v is None else "MEASURED_ZERO" if v == 0 else "ESTIMATED"
            rows.append({"cell_id": o.cell.cell_id, "estimand_id": o.cell.estimand_id, "family_id": f, "status": state, "effect": v if state in ("MEASURED_ZERO", "ESTIMATED") else None, "reason": o.reason if state == "CELL_REFUSED" else ""})
    return rows


def within_estimands(spark: SparkSession, states: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Stability of each family within each estimand (A20): counts, signs, least, middle and greatest effect, and the cells."""
    df = spark.createDataFrame([(s["cell_id"], s["estimand_id"], s["family_id"], s["status"], s["effect"]) for s in states], "cell_id string, estimand_id string, family_id string, status string, effect double")
    e = F.col("effect")
    out = df.filter("effect IS NOT NULL").groupBy("estimand_id", "family_id").agg(
        F.count("*").alias("n_cells"), F.count_if(e > 0).alias("n_positive"), F.count_if(e < 0).alias("n_negative"), F.count_if(e == 0).alias("n_zero"), F.min(e).alias("minimum"), F.percentile(e, 0.5).alias("median"), F.max(e).alias("maximum"), F.sort_array(F.collect_set("cell_id")).alias("cell_ids"))
    agree = F.concat(F.greatest("n_positive", "n_negative").cast("string"), F.lit("/"), F.col("n_cells").cast("string"), F.lit(" share a sign"))
    return out.withColumns({"sign_agreement": agree, "group_key": F.concat_ws("/", "estimand_id", "family_id")})


def histogram(outcomes: Sequence[Outcome]) -> dict[str, int]:
    """Cells by status, zeros kept."""
    return {s: sum(o.status == s for o in outcomes) for s in CELL}


def run_design(spark: SparkSession, path: str | Path, out: str | Path) -> tuple[list[Outcome], DataFrame]:
    """Plan, run every cell, sum up within estimands under the pooling guard, and write the tables."""
    meta, estimands, measurements, choices = read_design(path)
    cells = specifications(meta["root"], estimands, measurements, choices)
    manifest = {"multiverse_id": meta["multiverse_id"], "n_planned": len(cells), "cells": [{"cell_id": c.cell_id, "estimand_id": c.estimand_id, "measurement_id": c.measurement.measurement_id, "statistical_id": c.choice.statistical_id} for c in cells]}
    log, held = GuardLog("multiverse", out), {}

    def table(name: str) -> DataFrame:
        if name not in held:
            held[name] = read_hits(spark, str(Path(meta["root"], name))).persist()
        return held[name]

    try:
        outcomes = [run_cell(spark, meta["root"], c, table, log) for c in cells]
        states = family_states(outcomes)
        summaries = within_estimands(spark, states)
        verdict = no_cross_estimand_pooling(summaries, spark.createDataFrame([(c.cell_id, c.estimand_id) for c in cells], "cell_id string, estimand_id string"))
        log.record(verdict, "summaries within estimands")
        if not verdict.passed:
            raise Refusal(verdict.detail)
        rows = [r.asDict() for r in summaries.orderBy("estimand_id", "family_id").collect()]
        done = [{"cell_id": o.cell.cell_id, "estimand_id": o.cell.estimand_id, "status": o.status, "reason": o.reason} for o in outcomes]
        effects = [{"cell_id": o.cell.cell_id, **e} for o in outcomes if o.reading for e in (o.reading.effects or ())]
        columns = ("cell_id", "estimand_id", "status", "reason")
        write_grid(out, {
            "cells": (columns, done), "dropped_cells": (columns, [d for d in done if d["status"] != SUCCESS]), "family_effects": (tuple(effects[0]) if effects else ("cell_id", "family_id", "effect"), effects),
            "family_cells": (("cell_id", "estimand_id", "family_id", "status", "effect", "reason"), states), "stability_by_estimand": (("estimand_id", "family_id", "n_cells", "n_positive", "n_negative", "n_zero", "sign_agreement", "minimum", "median", "maximum", "cell_ids"), rows),
            "cell_guard_outcomes": (("guard_id", "passed", "detail", "subject"), log.held),
        }, {**manifest, "by_status": histogram(outcomes)}, curve_text(rows, done, [{"estimand_id": short, "query_id": e.query_id, "label": e.label} for e, short in {c.estimand: c.estimand_id for c in cells}.items()]))
        return outcomes, summaries
    finally:
        for df in held.values():
            df.unpersist()
