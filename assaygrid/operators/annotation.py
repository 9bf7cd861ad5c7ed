"""Annotation of motifs: what backends propose, families by a vocabulary, consensus."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.identity import candidate_id, row_id
from ..sources.readers import Refusal
from ..sources.scratch import ship
from .guards import low_confidence

MATCH = {"node_id": "string", "source": "string", "source_version": "string", "matched_motif_id": "string", "q": "double"}
LEAST_AGREEING = 2  # fixed value: a consensus has two votes at least


class Backend(Protocol):
    """Anything that proposes matches for nodes: (node_id, source, source_version, matched_motif_id, q)."""

    name: str
    optional: bool

    def annotate(self, nodes: DataFrame) -> DataFrame: ...


class Matches:
    """A backend over matches read beforehand."""

    def __init__(self, name: str, table: DataFrame, optional: bool = False):
        self.name, self.table, self.optional = name, table, optional

    def annotate(self, nodes: DataFrame) -> DataFrame:
        return self.table


class Table:
    """A backend over a table of matches of any size: Spark reads its partitions, and filters of section and nodes reach the files."""

    def __init__(self, name: str, path: str, version: str, optional: bool = False):
        self.name, self.path, self.version, self.optional = name, path, version, optional

    def annotate(self, nodes: DataFrame) -> DataFrame:
        rows = nodes.sparkSession.read.parquet(self.path)
        missing = [c for c in MATCH if c not in rows.columns]
        if missing:
            raise Refusal(f"{self.path}: missing columns {', '.join(missing)}")
        own = rows.filter((F.col("source") == self.name) & (F.col("source_version") == self.version)).select(*[F.col(c).cast(t).alias(c) for c, t in MATCH.items()])
        if not own.take(1):
            raise Refusal(f"{self.path}: no match of {self.name} in version {self.version}")
        return own


class Tool:
    """A backend that works matches out in tasks: ``match(motifs)`` takes a pandas frame of nodes and gives one of (node_id, matched_motif_id, q)."""

    def __init__(self, name: str, version: str, match: Callable, optional: bool = False):
        self.name, self.version, self.match, self.optional = name, version, match, optional

    def annotate(self, nodes: DataFrame) -> DataFrame:
        ship(nodes.sparkSession)
        match = self.match

        def run(pdfs):
            for pdf in pdfs:
                found = match(pdf)
                if len(found):
                    yield found[["node_id", "matched_motif_id", "q"]]

        out = nodes.mapInPandas(run, "node_id string, matched_motif_id string, q double")
        return out.select("node_id", F.lit(self.name).alias("source"), F.lit(self.version).alias("source_version"), "matched_motif_id", "q")


def annotate(nodes: DataFrame, backends: Sequence[Backend], occurrence: DataFrame | None = None) -> tuple[DataFrame | None, list[dict]]:
    """Candidates of all backends, and what became of each backend.

    nodes: node_id, core_length, seqlet_count.  A match of an unknown node refuses its backend (J07); an optional
    backend that fails is UNVERIFIED, another one ends the run.  Occurrence nulls join by candidate (J08).
    """
    out, log = None, []
    for b in backends:
        try:
            found = b.annotate(nodes)
            unknown = found.join(nodes, "node_id", "left_anti").limit(1).collect()
            if unknown:
                raise Refusal(f"{b.name} names node {unknown[0].node_id}, which is not registered")
        except Exception as error:
            if not b.optional:
                raise
            log.append({"backend": b.name, "status": "UNVERIFIED", "reason": str(error)})
            continue
        log.append({"backend": b.name, "status": "VERIFIED", "reason": ""})
        out = found if out is None else out.unionByName(found)
    if out is None:
        return None, log
    best = out.groupBy("node_id", "source", "source_version", "matched_motif_id").agg(F.min("q").alias("q"))
    rows = best.join(nodes.select("node_id", "core_length", "seqlet_count"), "node_id").withColumn("candidate_id", candidate_id(F.col("node_id"), F.col("source"), F.col("source_version"), F.col("matched_motif_id")))
    rows = rows.withColumn("low_confidence_annotation", low_confidence(F.col("core_length"), F.col("source"), F.col("q"), F.col("seqlet_count")))
    return (rows.join(occurrence, "candidate_id", "left") if occurrence is not None else rows.withColumn("occurrence_null", F.lit(None).cast("double"))), log


def core_length(start: str = "core_start", end: str = "core_end") -> Column:
    """Rows of a declared core; null where none is declared or it is no span."""
    s, e = F.col(start), F.col(end)
    return F.when((s >= 0) & (e > s), e - s)


def declared_core(mat: str = "mat", start: str = "core_start", end: str = "core_end") -> Column:
    """The matrix's rows inside the declared core; null without one or beyond the matrix."""
    return F.when((F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(end) <= F.size(mat)), F.slice(F.col(mat), F.col(start) + 1, F.col(end) - F.col(start)))


def four_wide(mat: str = "mat") -> Column:
    """Whether every row has four numbers."""
    return F.coalesce((F.size(mat) > 0) & F.forall(mat, lambda r: F.size(r) == 4), F.lit(False))


def reverse_complement(mat: str = "mat") -> Column:
    """Rows and columns turned round."""
    return F.transform(F.reverse(F.col(mat)), lambda r: F.reverse(r))


def consensus(candidates: DataFrame, vocabulary: DataFrame, nodes: DataFrame, rule: Mapping[str, str], least: int = LEAST_AGREEING) -> DataFrame:
    """node_id, state, family_id, n_candidates, n_resolved, evidence, assignment_id of every node.

    A family wins with ``least`` votes and alone at the top; who has no candidate, none known, or a tie, says so.
    """
    if least < LEAST_AGREEING:
        raise Refusal("one vote is no consensus")
    if vocabulary.groupBy("matched_motif_id").count().filter("count > 1").take(1):
        raise Refusal("a motif has two families in the vocabulary")
    votes = candidates.select("node_id", "matched_motif_id").distinct().join(vocabulary.select("matched_motif_id", "family_id"), "matched_motif_id", "left")
    per = votes.groupBy("node_id").agg(F.count("*").alias("n_candidates"), F.count("family_id").alias("n_resolved"), F.sort_array(F.collect_list(F.struct("matched_motif_id", "family_id"))).alias("evidence"))
    by = votes.filter("family_id IS NOT NULL").groupBy("node_id", "family_id").count().withColumn("top", F.max("count").over(W.partitionBy("node_id")))
    best = by.groupBy("node_id").agg(F.max("top").alias("top"), F.count_if(F.col("count") == F.col("top")).alias("ties"), F.count("*").alias("families"), F.min(F.when(F.col("count") == F.col("top"), F.col("family_id"))).alias("best"))
    out = nodes.select("node_id").join(per, "node_id", "left").join(best, "node_id", "left")
    n, top = F.coalesce("n_resolved", F.lit(0)), F.coalesce("top", F.lit(0))
    state = (
        F.when(F.coalesce("n_candidates", F.lit(0)) == 0, "NO_CANDIDATE").when(n == 0, "UNDECLARED").when((top < least) & (n < least), "TOO_FEW").when((top < least) | (F.col("ties") > 1), "SPLIT")
        .when(F.col("families") == 1, "UNANIMOUS").otherwise("MAJORITY")
    )
    named = row_id("family", node_id=F.col("node_id"), **{k: F.lit(rule[k]) for k in ("rule_id", "rule_version", "vocabulary_id", "vocabulary_version")})
    return out.select("node_id", state.alias("state"), F.when(state.isin("UNANIMOUS", "MAJORITY"), F.col("best")).alias("family_id"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), n.alias("n_resolved"), "evidence", named.alias("assignment_id"))


def variant_assigned(source: Column, variant: Column) -> Column:
    """Whether a variant is a claim and not a counter's placeholder; a source that is not stated counts as one (P20)."""
    filled = lambda c: c.isNotNull() & (F.trim(c) != "") & (c != "NA")
    return F.coalesce(filled(variant) & (source.isNull() | filled(source)), F.lit(False))


def translate(df: DataFrame, table: DataFrame, ident: str, namespace: str) -> DataFrame:
    """df with ident put into another namespace (table: namespace, ident, value); an id without translation is refused."""
    own = table.filter(F.col("namespace") == namespace).select(F.col("ident").alias(ident), F.col("value").alias("__to"))
    unknown = df.join(own, ident, "left_anti").limit(1).collect()
    if unknown:
        raise Refusal(f"{unknown[0][ident]} has no {namespace}")
    return df.join(own, ident).withColumn(ident, F.col("__to")).drop("__to")


def variant_counters(patterns: DataFrame) -> DataFrame:
    """patterns (union_id, analysis, metacluster, pattern) with a placeholder variant_id, counted within each union."""
    order = W.partitionBy("union_id").orderBy("analysis", F.when(F.col("metacluster") == "pos", 0).otherwise(1), "pattern")
    place = F.row_number().over(order) - 1
    return patterns.withColumns({"variant_id": F.concat("union_id", F.lit("_UNASSIGNED_"), F.when(place < 10, F.concat(F.lit("0"), place.cast("string"))).otherwise(place.cast("string"))), "variant_assignment_source": F.lit("NA")})
