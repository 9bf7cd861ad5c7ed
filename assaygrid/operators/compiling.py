"""Compiling lexicons: tiers and overrides, collapses, loading order, comparisons of tiers, and what the writer did to matrices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import lexicon_hash
from ..sources.readers import Refusal
from .guards import AXES
from .selection import placed

# Tiers and what keeps a merge split in the sensitivity lexicon.
TIERS, LEXICONS = ("core", "expanded", "excluded"), ("core", "expanded", "sensitivity")
RELATIVE = 1e-12


def require_known(df: DataFrame, nodes: DataFrame, column: str, what: str) -> None:
    """Every id is a registered node."""
    unknown = df.select(F.col(column).alias("node_id")).join(nodes, "node_id", "left_anti").limit(1).collect()
    if unknown:
        raise Refusal(f"{what} names {unknown[0].node_id}, which is not registered")


def apply_tiers(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """nodes with overridden tiers, without the excluded ones; two tiers that differ need a reason."""
    require_known(overrides, nodes, "node_id", "a tier override")
    o = overrides.select("node_id", *[F.col(c).alias(f"__{c}") for c in ("discovery_tier", "analysis_tier", "tier_reason")])
    out = nodes.join(o, "node_id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in ("discovery_tier", "analysis_tier", "tier_reason")}).select(*nodes.columns)
    bad = out.filter(((F.col("discovery_tier") != F.col("analysis_tier")) & F.coalesce("tier_reason", F.lit("NA")).isin("NA", "")) | ~F.coalesce(F.col("analysis_tier").isin(*TIERS), F.lit(False))).limit(1).collect()
    if bad:
        raise Refusal(f"{bad[0].node_id}: its tiers differ without a reason, or are none")
    return out.filter(F.col("analysis_tier") != "excluded")


def triggers() -> Column:
    """Named reasons for which a merge stays split in the sensitivity lexicon."""
    named = [F.when(~F.col("merge_confidence").eqNullSafe("high"), F.lit("merge_confidence_not_high")), F.when(F.col("family_ambiguity"), F.lit("family_ambiguity")), F.when(F.col("threshold_sensitive"), F.lit("threshold_sensitive"))]
    return F.array_compact(F.array(*named))


def members(nodes: DataFrame, decisions: DataFrame, lexicon: str) -> DataFrame:
    """Nodes of one lexicon once its collapses are applied; a representative must survive into it."""
    require_known(decisions.select(F.explode("members").alias("m")), nodes, "m", "a decision")
    kept = nodes.filter(F.col("analysis_tier").isin(*(("core",) if lexicon == "core" else ("core", "expanded"))))
    merges = decisions.filter(F.col("decision") == "collapse")
    if lexicon == "sensitivity":
        merges = merges.filter(F.size(triggers()) == 0)
    here = merges.select("cluster_id", "representative", F.explode("members").alias("node_id")).join(kept.select("node_id"), "node_id", "left_semi")
    lost = here.select("cluster_id", F.col("representative").alias("node_id")).distinct().join(kept, "node_id", "left_anti").limit(1).collect()
    if lost:
        raise Refusal(f"{lost[0].cluster_id}: its representative {lost[0].node_id} is not in {lexicon}")
    return kept.join(here.filter(F.col("node_id") != F.col("representative")).select("node_id").distinct(), "node_id", "left_anti")


def loading_order(kept: DataFrame, by: str = "node_id") -> DataFrame:
    """kept with tag and pattern, as the loader reads them: positive before negative, numbered anew in each."""
    out = placed(kept, "metacluster", by)
    return out.withColumns({"tag": F.concat("metacluster", F.lit("_patterns")), "pattern": F.concat(F.lit("pattern_"), F.col("place").cast("string"))})


def compare_lexicons(one: DataFrame, other: DataFrame) -> DataFrame:
    """metacluster, n_one, n_other, only_one, only_other, same_set, same_order of two ordered lexicons (J16, W09: first difference)."""
    both = one.select("node_id", "metacluster", F.col("place").alias("i")).join(other.select("node_id", F.col("metacluster").alias("m"), F.col("place").alias("j")), "node_id", "full")
    out = both.groupBy(F.coalesce("metacluster", "m").alias("metacluster")).agg(F.count("i").alias("n_one"), F.count("j").alias("n_other"), F.count_if(F.col("j").isNull()).alias("only_one"), F.count_if(F.col("i").isNull()).alias("only_other"), F.min(F.when(~F.col("i").eqNullSafe(F.col("j")), F.coalesce("i", "j"))).alias("first_difference"))
    return out.withColumns({"same_set": (F.col("only_one") + F.col("only_other")) == 0, "same_order": F.col("first_difference").isNull()})


def one_length(matrices: DataFrame) -> None:
    """Motifs of one lexicon are as long as each other."""
    n = matrices.agg(F.count_distinct(F.size("mat")).alias("n")).first().n
    if n != 1:
        raise Refusal(f"{n} lengths of matrices in one lexicon")


def operations(emitted: DataFrame, registry: DataFrame, decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, op ('copy', 'mean', 'other'), group_by of each emitted matrix, read off the numbers themselves.

    emitted: node_id, mat; registry: the same of all nodes; a mean is the elementwise mean of a collapse's members.
    """
    long = lambda df: df.select("node_id", F.posexplode("mat").alias("row", "cells")).select("node_id", "row", F.posexplode("cells").alias("base", "v"))
    e = long(emitted).withColumnRenamed("v", "e")
    own = e.join(long(registry), ["node_id", "row", "base"], "left").groupBy("node_id").agg(F.bool_and(F.col("v").eqNullSafe(F.col("e"))).alias("copy"))
    merged = decisions.filter(F.col("decision") == "collapse").select(F.col("representative").alias("rep"), F.explode("members").alias("node_id"))
    mean = long(registry).join(merged, "node_id").groupBy(F.col("rep").alias("node_id"), "row", "base").agg(F.avg("v").alias("v"))
    near = F.abs(F.col("e") - F.col("v")) <= RELATIVE * F.greatest(F.abs("v"), F.abs("e"))
    avg = e.join(mean, ["node_id", "row", "base"]).groupBy("node_id").agg(F.bool_and(near).alias("mean"))
    held = merged.join(nodes, "node_id").groupBy(F.col("rep").alias("node_id")).agg(*[(F.count_distinct(a) == 1).alias(a) for a in AXES])
    group = F.array_compact(F.array(*[F.when(F.coalesce(F.col(a), F.lit(True)), F.lit(a)) for a in AXES]))
    out = own.join(avg, "node_id", "left").join(held, "node_id", "left")
    return out.select(F.col("node_id").alias("id"), F.when(F.col("copy"), "copy").when(F.coalesce("mean", F.lit(False)), "mean").otherwise("other").alias("op"), group.alias("group_by"))


def compiled(ordered: DataFrame, matrices: DataFrame, settings: Mapping) -> dict:
    """Members of one lexicon in loading order, with its semantic hash (F26); a lexicon fits the driver."""
    one_length(matrices.join(ordered, "node_id", "left_semi"))
    mats: dict[str, dict] = {}
    for r in matrices.join(ordered, "node_id", "left_semi").collect():
        mats.setdefault(r.node_id, {})[r.kind] = r.mat
    rows = sorted(ordered.select("tag", "pattern", "place", "node_id", "variant_id").collect(), key=lambda r: (r.tag != "pos_patterns", r.place))
    out = [{"tag": r.tag, "pattern": r.pattern, "node_id": r.node_id, "variant_id": r.variant_id, "matrices": mats.get(r.node_id, {})} for r in rows]
    return {"members": out, "manifest": {"lexicon_content_hash": lexicon_hash(out, settings), "node_ids": [r.node_id for r in rows], **settings}}
