"""Criteria as data: named predicates over evidence fields, checked on the driver and compiled to Columns.

A criterion defers where it is undefined or evidence is missing, decides where all predicates hold, and else refuses.
From schema version 2 on each threshold says whether it was declared or derived, and a derived one is recomputed.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.readers import Refusal

# Ranges of the evidence fields, fields that hold grades, statuses.
DOMAINS = {"overlap_frac_source": (0.0, 1.0), "overlap_frac_target": (0.0, 1.0), "ppm_similarity": (-1.0, 1.0), "signed_cwm_similarity": (-1.0, 1.0), "empirical_p_value": (0.0, 1.0)}
GRADES = {"merge_confidence", "discovery_tier", "analysis_tier", "missingness", "decision", "selection_provenance", "status", "orientation"}
FROZEN, HEURISTIC, UNDEFINED = "FROZEN", "FROZEN_DECLARED_HEURISTIC", "CRITERION_NOT_YET_DEFINED"
DECISIONS = ("collapse", "refuse_merge", "keep_separate", "deferred")
OPERATORS = {
    "ge": lambda c, v: c >= v, "le": lambda c, v: c <= v, "eq": lambda c, v: c == v, "is_true": lambda c, _: c.cast("boolean"), "present": lambda c, _: c.isNotNull(),
}


def landmark(field: str, source: Mapping[str, Any]) -> float:
    """The end or the sign boundary of the field's own range that ``derived_from`` names."""
    if not isinstance(source, Mapping) or set(source) != {"evidence_domain", "endpoint"}:
        raise Refusal(f"{field}: derived_from names evidence_domain and endpoint, nothing else")
    if source["evidence_domain"] != field or field not in DOMAINS:
        raise Refusal(f"{field}: a threshold derives from the recorded range of its own field")
    low, high = DOMAINS[field]
    match source["endpoint"]:
        case "min":
            return low
        case "max":
            return high
        case "sign_boundary" if low < 0 < high:
            return 0.0
    raise Refusal(f"{field}: no endpoint {source['endpoint']} in [{low}, {high}]")


@dataclass(frozen=True)
class Predicate:
    field: str
    operator: str
    value: Any = None
    provenance: str | None = None
    basis: str | None = None
    derived_from: Mapping[str, Any] | None = None

    def __post_init__(self):
        threshold = self.operator in ("ge", "le")
        faults = {
            "no such operator": self.operator not in OPERATORS,
            "a grade is named, not thresholded": threshold and self.field in GRADES,
            "a comparison needs a value": self.operator in ("ge", "le", "eq") and self.value is None,
            "provenance is declared or derived": self.provenance not in (None, "declared", "derived"),
            "only a threshold has provenance": not threshold and self.provenance is not None,
            "provenance and basis come together": (self.provenance is None) != (not str(self.basis or "").strip()),
            "only a derived value names its source": self.derived_from is not None and self.provenance != "derived",
        }
        for what, wrong in faults.items():
            if wrong:
                raise Refusal(f"predicate {self.field} {self.operator}: {what}")
        if self.derived_from is not None and float(self.value) != landmark(self.field, self.derived_from):
            raise Refusal(f"predicate {self.field}: {self.value} is not {landmark(self.field, self.derived_from)}")

    def column(self) -> Column:
        return OPERATORS[self.operator](F.col(self.field), self.value)

    def __str__(self):
        return f"{self.field} {self.operator}" + ("" if self.value is None else f" {self.value}")


@dataclass(frozen=True)
class Criterion:
    criterion_id: str
    version: str
    status: str
    relationship: str
    required_evidence: tuple[str, ...]
    predicates: tuple[Predicate, ...] = ()
    insufficient_evidence_action: str = "deferred"
    decision_if_matched: str | None = None
    declared_rationale: str | None = None
    replacement_evidence: tuple[str, ...] = ()

    def __post_init__(self):
        live, declared = self.status in (FROZEN, HEURISTIC), [p for p in self.predicates if p.provenance == "declared"]
        faults = {
            "a criterion has a name": not self.criterion_id.strip(),
            f"no status {self.status}": self.status not in (FROZEN, HEURISTIC, UNDEFINED),
            "missing evidence can only defer": self.insufficient_evidence_action != "deferred",
            "evidence must be named": not self.required_evidence,
            "predicates read named evidence only": not {p.field for p in self.predicates} <= set(self.required_evidence),
            "a live criterion has predicates and a decision": live and (not self.predicates or self.decision_if_matched not in DECISIONS),
            "a chosen number makes a heuristic": self.status == FROZEN and bool(declared),
            "a heuristic has a chosen number and says why": self.status == HEURISTIC and (not declared or not str(self.declared_rationale or "").strip()),
        }
        for what, wrong in faults.items():
            if wrong:
                raise Refusal(f"{self.criterion_id or 'criterion'}: {what}")

    def outcome(self) -> Column:
        """decision over rows that carry the evidence as columns; null evidence defers, before any predicate."""
        if self.status == UNDEFINED:
            return F.lit("deferred")
        missing = functools.reduce(operator.or_, [F.col(f).isNull() for f in self.required_evidence])
        return F.when(missing, "deferred").when(functools.reduce(operator.and_, [p.column() for p in self.predicates]), self.decision_if_matched).otherwise("refuse_merge")

    def rationale(self) -> Column:
        """What was missing, what failed, or that all held; chosen numbers are named with every decision."""
        if self.status == UNDEFINED:
            return F.lit(f"{self.criterion_id} v{self.version} is not yet defined")
        which = lambda pairs: F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull()), ", ")
        missing = which([(f, F.col(f).isNull()) for f in self.required_evidence])
        failed = which([(str(p), ~F.coalesce(p.column(), F.lit(False))) for p in self.predicates])
        said = F.when(missing != "", F.concat(F.lit("missing evidence: "), missing)).when(failed != "", F.concat(F.lit("not met: "), failed)).otherwise("all predicates hold")
        chosen = [str(p) for p in self.predicates if p.provenance == "declared"]
        caveat = f"; chosen, not derived: {', '.join(chosen)}" if self.status == HEURISTIC else ""
        return F.concat(F.lit(f"{self.criterion_id} v{self.version}: "), said, F.lit(caveat))

    def admits(self, geometry: set[str]) -> Column:
        """The predicates on a pair's geometry alone, as a filter of proposed pairs; a missing value does not admit."""
        own = [F.coalesce(p.column(), F.lit(False)) for p in self.predicates if p.field in geometry]
        return functools.reduce(operator.and_, own, F.lit(True))


def read_criteria(path: str) -> dict[str, Criterion]:
    """Criteria of a YAML file by id; unknown keys, versions and unattributed thresholds are refused."""
    import yaml

    with open(path, encoding="utf-8") as f:
        whole = yaml.safe_load(f) or {}
    if not isinstance(whole, Mapping) or set(whole) - {"schema_version", "criteria"} or str(whole.get("schema_version")) not in ("1", "2"):
        raise Refusal(f"{path}: a mapping of schema_version (1 or 2) and criteria")
    out: dict[str, Criterion] = {}
    for entry in whole.get("criteria") or []:
        entry = dict(entry)
        own = [dict(p) for p in entry.pop("predicates", None) or []]
        known, inside = {f.name for f in fields(Criterion)}, {f.name for f in fields(Predicate)}
        if set(entry) - known or any(set(p) - inside for p in own):
            raise Refusal(f"{path}: unknown keys {sorted(set(entry) - known | {k for p in own for k in set(p) - inside})}")
        for k in ("required_evidence", "replacement_evidence"):
            entry[k] = tuple(entry.get(k) or ())
        c = Criterion(**{**entry, "version": str(entry.get("version"))}, predicates=tuple(Predicate(**p) for p in own))
        if str(whole["schema_version"]) == "2":
            for p in c.predicates:
                if p.operator in ("ge", "le") and (p.provenance is None or (p.provenance == "derived" and p.derived_from is None)):
                    raise Refusal(f"{path}: {c.criterion_id}: {p} does not say where its number comes from")
        if c.criterion_id in out:
            raise Refusal(f"{path}: {c.criterion_id} twice")
        out[c.criterion_id] = c
    return out


def at_null_floor(p: str = "empirical_p_value", shuffles: str = "null_shuffles") -> Column:
    """Whether a null could not have given less; null where there was none."""
    return F.when(F.col(p).isNotNull() & (F.col(shuffles) >= 1), F.col(p) <= 1 / (F.col(shuffles) + 1))
