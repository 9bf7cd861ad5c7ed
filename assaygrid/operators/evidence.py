"""Adjudication under a file of criteria, with annotation and stability as evidence.

Families are those that motifs declare and those that confident annotation candidates propose.  The relationship
of a proposed cluster picks its criterion; its evidence is the cluster's own (families, variants, stability of the decision)
and, for each member, the registered pair with the medoid.  All of it is joins and grouped sums: a cluster's members,
pairs and candidates are never one row.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import member_names, row_id
from ..plans.relations import CATALOGUE as C
from ..sources.readers import Refusal
from ..sources.scratch import written
from .adjudication import GEOMETRY, SHUFFLES
from .annotation import variant_assigned
from .criteria import Criterion, at_null_floor

# Relationships in the order in which they are told.
CONFLICT, VARIANT, FRAGMENT, DUPLICATE = RELATIONSHIPS = ("AMBIGUOUS_CROSS_FAMILY", "SAME_FAMILY_VARIANT", "FRAGMENT_MATCH", "TRUE_DUPLICATE")


def by_relationship(criteria: Mapping[str, Criterion]) -> dict[str, Criterion]:
    """One criterion for each relationship."""
    out: dict[str, Criterion] = {}
    for c in criteria.values():
        if c.relationship in out:
            raise Refusal(f"two criteria for {c.relationship}: {out[c.relationship].criterion_id} and {c.criterion_id}")
        out[c.relationship] = c
    return out


def _each(criteria: Mapping[str, Criterion], what) -> Column:
    """``what(criterion)`` of the criterion that the row's relationship picks."""
    return functools.reduce(lambda w, rc: F.when(F.col("relationship") == rc[0], what(rc[1])).otherwise(w), criteria.items(), F.lit(None))


def _carrying(df: DataFrame, criteria: Mapping[str, Criterion]) -> DataFrame:
    """df with a null column for each field of evidence that nobody brought."""
    need = {f for c in criteria.values() for f in c.required_evidence} - set(df.columns)
    return df.withColumns({f: F.lit(None).cast("double") for f in sorted(need)})


def cluster_families(members: DataFrame, motifs: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """component, n_members, n_families, family (the least), n_named, n_variants of (component, node)."""
    filled = lambda c: c.isNotNull() & ~F.trim(c).isin("", "NA")
    said = motifs.filter(filled(F.col("family"))).select("node", "family")
    if candidates is not None:
        said = said.unionByName(candidates.filter(~F.coalesce("low_confidence_annotation", F.lit(False)) & filled(F.col("family"))).select("node", "family"))
    named = members.join(said, "node").groupBy("component").agg(F.count_distinct("family").alias("n_families"), F.min("family").alias("family"), F.count_distinct("node").alias("n_named"))
    source = F.col("variant_source") if "variant_source" in motifs.columns else F.lit(None).cast("string")
    assigned = variant_assigned(source, F.col("variant"))
    sized = members.join(motifs, "node").groupBy("component").agg(F.count("*").alias("n_members"), F.count_if(assigned).alias("n_assigned"), F.count_distinct(F.when(assigned, F.col("variant"))).alias("variants"))
    out = sized.join(named, "component", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("component", "n_members", zero("n_families"), "family", zero("n_named"), F.when(F.col("n_assigned") == F.col("n_members"), F.col("variants")).alias("n_variants"))


def adjudicate_under(criteria: Mapping[str, Criterion], edges: DataFrame, motifs: DataFrame, candidates: DataFrame | None = None, stability: DataFrame | None = None) -> DataFrame:
    """Decisions of every proposed cluster under criteria (by id), in the two passes of ``adjudication.adjudicate_all``.

    edges: u < v with evidence fields; motifs: node, family, variant[, variant_source], completeness, seqlets, core_ic,
    recurrence; candidates: node, family, low_confidence_annotation; stability: decision_id, status, n_affected_peaks and
    further fields, one row for a decision.  An absent pair, a tied medoid without the field that tells, or missing
    evidence defers; a conflict of families always refuses.
    """
    rules = by_relationship(criteria)
    known = motifs.select("node")
    for what, nodes in (("an edge", edges.select(F.explode(F.array("u", "v")).alias("node"))), *((("a candidate", candidates.select("node")),) if candidates is not None else ())):
        if nodes.join(known, "node", "left_anti").take(1):
            raise Refusal(f"{what} names a motif that is not registered")
    if edges.filter("u = v").take(1) or edges.groupBy(F.least("u", "v"), F.greatest("u", "v")).count().filter("count > 1").take(1):
        raise Refusal("a pair of one motif with itself, or a pair registered twice")
    if stability is not None and stability.groupBy("decision_id").count().filter("count > 1").take(1):
        raise Refusal("two stability results of one decision")
    shuffles = "null_shuffles" if "null_shuffles" in edges.columns else None
    edges = written(edges if shuffles else edges.withColumn("null_shuffles", F.lit(SHUFFLES)), "edges").withColumn("at_alignment_null_floor", at_null_floor())
    out, seen = None, None
    passes = [("wide", edges)]
    if DUPLICATE in rules:
        passes.append(("tight", edges.filter(rules[DUPLICATE].admits(set(GEOMETRY)))))
    for name, proposing in passes:
        comp = written(C.over("comp", {"edges": proposing.select("u", "v")}), name)
        names = written(member_names(comp).select("component", "members"), "members")
        if seen is not None:
            names = names.join(seen, "members", "left_anti")
        seen = names.select("members") if seen is None else seen.unionAll(names.select("members"))
        own = written(comp.join(names.select("component"), "component", "left_semi"), "proposed")
        found = _decided(rules, own, names, edges, motifs, candidates, stability).withColumn("pass", F.lit(name))
        out = found if out is None else out.unionAll(found)
    out = written(out, "decisions")
    if out.groupBy("decision_id").count().filter("count > 1").take(1):
        raise Refusal("two decisions of one name")
    return out


def _decided(rules, own, names, edges, motifs, candidates, stability) -> DataFrame:
    side = lambda c, x: own.select(F.col("node").alias(c), F.col("component").alias(x))
    inside = written(edges.join(side("u", "__a"), "u").join(side("v", "__b"), "v").filter("__a = __b").select(*edges.columns), "inside")
    held = {"edges": inside, "motif": motifs, "comp": own, "comp_members": written(cluster_families(own, motifs, candidates), "cluster-families")}
    kinds = C.over("comp_kind", held).select("component", "registered", "relationship")
    missing = [r.relationship for r in kinds.select("relationship").distinct().collect() if r.relationship not in rules]
    if missing:
        raise Refusal(f"no criterion is registered for {', '.join(sorted(missing))}")
    c = held["comp_members"].join(kinds, "component").join(names, "component")
    c = c.withColumns({
        "criterion_id": _each(rules, lambda r: F.lit(r.criterion_id)), "criterion_version": _each(rules, lambda r: F.lit(r.version)), "alignment_registered": F.lit(True), "family_conflict": F.col("n_families") > 1,
        "same_family": (F.col("n_families") == 1) & (F.col("n_named") == F.col("n_members")), "distinct_variant_ids": F.col("n_variants") > 1,
    })
    c = c.withColumn("decision_id", row_id("decision", {"node_ids": F.col("members")}, relationship=F.col("relationship"), criterion_id=F.col("criterion_id"), criterion_version=F.col("criterion_version"), schema_version=F.lit("1")))
    if stability is not None:
        c = c.join(stability.withColumn("downstream_stability_present", F.lit(True)), "decision_id", "left")
    c = written(c, "clusters")
    medoids = C.over("medoid", held).select("component", "medoid", "missing_field")
    pairs = inside.select(F.col("u").alias("__u"), F.col("v").alias("__v"), *[F.col(x) for x in inside.columns if x not in ("u", "v", *c.columns)])
    rows = own.join(medoids, "component").filter("node <> medoid").join(c, "component")
    rows = _carrying(rows.join(pairs, (F.least("node", "medoid") == F.col("__u")) & (F.greatest("node", "medoid") == F.col("__v")), "left"), rules)
    judged = rows.select("component", "node", _each(rules, Criterion.outcome).alias("outcome"), _each(rules, Criterion.rationale).alias("said"))
    gates = judged.groupBy("component").agg(F.bool_and(F.col("outcome") == "collapse").alias("all_pass"), F.bool_or(F.col("outcome") == "refuse_merge").alias("one_fails"), F.min(F.when(F.col("outcome") != "collapse", F.concat(F.col("node").cast("string"), F.lit(": "), F.col("said")))).alias("against"))
    structural = F.col("relationship").isin(CONFLICT, VARIANT)
    whole = _carrying(c, rules).withColumns({"__own": _each(rules, Criterion.outcome), "__said": _each(rules, Criterion.rationale)}).select("component", "__own", "__said")
    d = c.join(medoids, "component").join(gates, "component").join(whole, "component")
    absent, tied = F.col("n_members") * (F.col("n_members") - 1) / 2 - F.col("registered"), F.col("missing_field").isNotNull()
    decision = F.when(absent > 0, "deferred").when(F.col("relationship") == CONFLICT, "refuse_merge").when(structural, F.col("__own")).when(tied, "deferred").when(F.col("all_pass"), "collapse").when(F.col("one_fails"), "refuse_merge").otherwise("deferred")
    why = (
        F.when(absent > 0, F.concat(absent.cast("long").cast("string"), F.lit(" pairs of the cluster are not registered"))).when(F.col("relationship") == CONFLICT, F.concat(F.lit("families conflict; "), F.col("__said"))).when(structural, F.col("__said"))
        .when(tied, F.concat(F.lit("medoids tie and "), F.col("missing_field"), F.lit(" is missing"))).when(F.col("all_pass"), "every member passes its gate").otherwise(F.col("against"))
    )
    return d.select("decision_id", "component", "relationship", "n_members", decision.alias("decision"), F.when(decision == "collapse", F.col("medoid")).alias("representative"), F.when(F.col("n_families") == 1, F.col("family")).alias("family_id"), "criterion_id", "criterion_version", why.alias("rationale"), "members")
