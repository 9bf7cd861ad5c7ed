"""Registered queries over the library's own functions: readings of a hit table, validation, compiling, criteria, guards.

The tables are derived by Spark from the given ones, whole; each query calls the function a user would, and its
checking text works the answer out another way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relations import CATALOGUE as C
from ..sources.scratch import discard, ship, written
from . import compiling, validation, watch
from .criteria import HEURISTIC, Criterion, Predicate
from .guards import comparator_declared, index_order_matches_loader, no_cross_estimand_pooling, stratum_parity, variant_id_unique
from .reading import Floors, Query, Reading, interpret, region_family, universe

QUERIES, ORACLES = {}, {}
BLOCK = 20000


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opportunity of every region, in the columns of a hit table."""
    h = C.run("hits")(spark, sf_dir)
    return h.select(F.col("region_id").cast("string").alias("region_id"), "chrom", F.col("start_bp").alias("start"), F.col("end_bp").alias("end"), F.col("variant").alias("variant_id"), F.col("family").alias("family_id"),
                    F.col("coefficient").alias("hit_coefficient"), F.col("state").alias("missingness"), F.lit(1).cast("long").alias("input_scale"), F.lit("all").alias("lexicon_id"), F.lit("a" * 64).alias("substrate_id"))


def reading(spark: SparkSession, sf_dir: str, **how) -> Reading:
    """The regions of status F against those of status O, as chosen from outside."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    side = lambda s: orders.filter(F.col("o_orderstatus") == s).select(F.col("o_orderkey").cast("string").alias("region_id"))
    hits = written(hit_table(spark, sf_dir), "hit-table")
    return interpret(hits, Query("F", side("F"), side("O"), "O", "EXTERNAL"), Floors(0.9, 1, 0.1), BLOCK, 200, 7, **how)


_HIT = f"""
WITH hit AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS region_id, o_orderpriority AS chrom, o_orderkey * 100 AS s, o_orderkey * 100 + 50 AS e, o_orderstatus AS side, o_orderpriority || ':' || CAST(floor(o_orderkey * 100 / {BLOCK}) AS BIGINT) AS block,
         p_type AS family, l_discount >= 0.02 AS used, l_orderkey IS NOT NULL OR o_orderstatus <> 'P' AS searched,
         CASE WHEN l_discount >= 0.02 THEN (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice * (1 - l_discount) / 1000 END AS v
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey)"""


@query(_HIT + " SELECT region_id, any_value(chrom) AS chrom, any_value(s) AS start, any_value(e) AS \"end\", any_value(block) AS block, CAST(any_value(searched) AS INT) AS searched, count(*) FILTER (used) AS n_used, round(coalesce(sum(abs(v)), 0), 7) AS mass FROM hit GROUP BY region_id")
def hit_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe(hit_table(spark, sf_dir), BLOCK).withColumn("mass", F.round(F.coalesce("mass", F.lit(0.0)), 7))


@query(_HIT + " SELECT region_id, family, count(*) FILTER (used) AS n_hits, round(coalesce(sum(v), 0), 7) AS signed, round(coalesce(sum(abs(v)), 0), 7) AS mass FROM hit WHERE searched AND family IS NOT NULL GROUP BY region_id, family")
def hit_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_family(hit_table(spark, sf_dir)).withColumns({c: F.round(c, 7) for c in ("signed", "mass")})


@query(_HIT + """,
r AS (SELECT region_id, any_value(side) AS side, any_value(block) AS block, bool_or(searched) AS searched, bool_or(used) AS explained FROM hit WHERE side IN ('F', 'O') GROUP BY region_id),
b AS (SELECT block, bool_or(side = 'F') AND bool_or(side = 'O') AS shared FROM r WHERE searched GROUP BY block)
SELECT CASE side WHEN 'F' THEN 'query' ELSE 'comparator' END AS side, count(*) AS n_submitted, count(*) AS n_in_universe, count(*) FILTER (searched) AS n_searched, count(DISTINCT block) FILTER (searched) AS n_blocks, 1.0::DOUBLE AS intersection_coverage,
       round(count(*) FILTER (searched AND explained) / count(*) FILTER (searched), 9) AS explained_fraction, (SELECT count(*) FROM b) AS union_blocks, (SELECT count(*) FROM b WHERE shared) AS shared_blocks FROM r GROUP BY side""")
def reading_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reading(spark, sf_dir)
    rows = [(side, h["n_submitted"], h["n_in_universe"], h["n_searched"], h["n_blocks"], h["intersection_coverage"], round(h["explained_fraction"], 9), r.contrast["union_blocks"], r.contrast["shared_blocks"]) for side, h in (("query", r.health), ("comparator", r.comparator_health))]
    return spark.createDataFrame(rows, "side string, n_submitted long, n_in_universe long, n_searched long, n_blocks long, intersection_coverage double, explained_fraction double, union_blocks long, shared_blocks long")


@query(_HIT + """,
n AS (SELECT count(DISTINCT region_id) AS n FROM hit WHERE side = 'F' AND searched),
f AS (SELECT region_id, family, count(*) FILTER (used) > 0 AS with_family, sum(v) AS v FROM hit WHERE side = 'F' AND searched AND family IS NOT NULL GROUP BY ALL)
SELECT family, count(*) FILTER (with_family) AS n_with_family, (SELECT n FROM n) AS n_searched, round(count(*) FILTER (with_family) / (SELECT n FROM n), 9) AS share_with_family, round(coalesce(sum(v), 0) / (SELECT n FROM n), 9) AS mean_coefficient FROM f GROUP BY family""")
def reading_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).composition or []
    return spark.createDataFrame([(r["family"], r["n_with_family"], r["n_searched"], float(r["share_with_family"]), r["mean_coefficient"]) for r in rows], "family string, n_with_family long, n_searched long, share_with_family double, mean_coefficient double")


# whole blocks drawn one by one: the blocks of both sides, numbered by the slot of their hash
_DRAWN = _HIT + """,
size AS (SELECT block, count(DISTINCT region_id) FILTER (side = 'F') AS nq, count(DISTINCT region_id) FILTER (side = 'O') AS nc FROM hit WHERE side IN ('F', 'O') AND searched GROUP BY block),
num AS (SELECT *, row_number() OVER (ORDER BY CAST(('0x' || substr(md5('block|' || block), 1, 8)) AS BIGINT) % 256, block) - 1 AS k, count(*) OVER () AS g FROM size),
fam AS (SELECT family FROM hit WHERE side IN ('F', 'O') AND family IS NOT NULL GROUP BY family HAVING count(*) FILTER (used) > 0),
dense AS (SELECT f.family, n.block, n.k, n.g, n.nq, n.nc, coalesce(sum(v) FILTER (side = 'F'), 0) AS q, coalesce(sum(v) FILTER (side = 'O'), 0) AS c FROM num n CROSS JOIN fam f LEFT JOIN hit h ON h.block = n.block AND h.family = f.family GROUP BY ALL),
rep AS (SELECT unnest(range(0, 200)) AS r),
draw AS (SELECT r, CAST(('0x' || substr(md5('7|' || r || '|' || k), 1, 8)) AS BIGINT) % g AS k FROM num, rep),
boot AS (SELECT family, r, round(sum(q) / sum(nq) - sum(c) / sum(nc), 9) AS x FROM draw JOIN dense USING (k) GROUP BY family, r HAVING sum(nq) > 0 AND sum(nc) > 0),
ends AS (SELECT family, list_sort(list(x)) AS l FROM boot GROUP BY family),
point AS (SELECT family, sum(q) / sum(nq) - sum(c) / sum(nc) AS effect, sum(nq) AS n_query, sum(nc) AS n_comparator, count(*) AS n_blocks FROM dense GROUP BY family)"""


@query(_DRAWN + """
SELECT family, round(effect, 9) AS effect, l[greatest(0, CAST(floor(0.025 * len(l)) AS BIGINT) - 1) + 1] AS ci_low, l[least(len(l) - 1, CAST(ceil(0.975 * len(l)) AS BIGINT) - 1) + 1] AS ci_high,
       CAST(n_query AS BIGINT) AS n_query, CAST(n_comparator AS BIGINT) AS n_comparator, n_blocks, len(l) AS n_valid FROM point JOIN ends USING (family)""")
def reading_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e["family_id"], e["effect"], e["ci_low"], e["ci_high"], e["n_query_peaks"], e["n_comparator_peaks"], e["n_blocks"], e["n_bootstrap_valid"]) for e in reading(spark, sf_dir).effects or []]
    return spark.createDataFrame(rows, "family string, effect double, ci_low double, ci_high double, n_query long, n_comparator long, n_blocks long, n_valid long")


@query(_HIT + """,
n AS (SELECT count(DISTINCT region_id) FILTER (side = 'F') AS q, count(DISTINCT region_id) FILTER (side = 'O') AS c FROM hit WHERE searched),
f AS (SELECT region_id, side, family, count(*) FILTER (used) > 0 AS u, coalesce(sum(v), 0) AS v FROM hit WHERE side IN ('F', 'O') AND family IS NOT NULL GROUP BY ALL)
SELECT family, any_value(q) AS n_q, any_value(c) AS n_c, round(count(*) FILTER (u AND side = 'F') / any_value(q) - count(*) FILTER (u AND side = 'O') / any_value(c), 9) AS occupancy_effect,
       round(avg(v) FILTER (u AND side = 'F') - avg(v) FILTER (u AND side = 'O'), 9) AS intensity_effect, round(coalesce(sum(v) FILTER (u AND side = 'F'), 0) / any_value(q) - coalesce(sum(v) FILTER (u AND side = 'O'), 0) / any_value(c), 9) AS total_effect,
       count(*) FILTER (u AND side = 'F')::DOUBLE AS used_query, count(*) FILTER (u AND side = 'O')::DOUBLE AS used_comparator FROM f, n GROUP BY family HAVING count(*) FILTER (u) > 0""")
def reading_two_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("family", "n_q", "n_c", "occupancy_effect", "intensity_effect", "total_effect", "used_query", "used_comparator")
    rows = [tuple(x if k in ("family", "n_q", "n_c") or x is None else float(x) for k, x in ((k, r[k]) for k in names)) for r in reading(spark, sf_dir, usage="any_hit").two_part or []]
    return spark.createDataFrame(rows, "family string, n_q long, n_c long, occupancy_effect double, intensity_effect double, total_effect double, used_query double, used_comparator double")


# Two runs over the peaks that both of them have.
_RUNS = """
WITH base AS (SELECT l_orderkey AS peak, l_partkey * 10 + l_linenumber AS hit, min(p_size) AS size, round(sum(l_extendedprice * (1 - l_discount) / 1000), 9) AS coef FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
b AS (SELECT peak, hit, coef FROM base WHERE size < 49), a AS (SELECT peak, hit, coef + CASE WHEN size <= 10 THEN 1e-9 WHEN size <= 12 THEN 1e-3 ELSE 0 END AS coef FROM base WHERE size > 2),
met AS (SELECT peak FROM b INTERSECT SELECT peak FROM a),
j AS (SELECT coalesce(b.peak, a.peak) AS peak, coalesce(b.hit, a.hit) AS hit, b.coef AS o, a.coef AS w FROM b FULL JOIN a ON a.peak = b.peak AND a.hit = b.hit WHERE coalesce(b.peak, a.peak) IN (SELECT peak FROM met))"""


_TWO = ("before_hits", "after_hits")


def _base(sf_dir: str):
    return lambda t: f"parquet.`{sf_dir}/{t}.parquet`"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The hits that both runs are drawn from, and the peaks that both of them have; hits are worked out once."""
    hits = written(C.plan(spark, "base_hits", _base(sf_dir), {}), "base-hits")
    ran = [C.over(n, {"base_hits": hits}).select("peak", F.lit(i).alias("run")) for i, n in enumerate(_TWO)]
    both = ran[0].unionAll(ran[1]).groupBy("peak").agg(F.min("run").alias("first"), F.max("run").alias("last")).filter("first < last").select("peak")
    return hits, both


@query(_RUNS + """,
p AS (SELECT peak, bool_or(o IS NULL OR w IS NULL OR abs(w - o) > 3.63e-07) AS hot FROM j GROUP BY peak),
d AS (SELECT p.*, CASE WHEN o_orderkey % 4 = 0 THEN -5e-3 ELSE 0 END AS delta FROM p JOIN orders ON o_orderkey = peak)
SELECT (SELECT count(*) FROM d WHERE hot) AS n_affected_peaks, (SELECT count(*) FROM j JOIN p USING (peak) WHERE hot) AS n_affected_hits, (SELECT round(sum(abs(w)) FILTER (hot) / sum(abs(w)), 9) FROM j JOIN p USING (peak)) AS share,
       (SELECT round(count(*) FILTER (o IS NOT NULL AND w IS NOT NULL) / count(*), 9) FROM j JOIN p USING (peak) WHERE hot) AS jaccard, (SELECT round(corr(o, w), 6) FROM j JOIN p USING (peak) WHERE hot) AS pearson,
       (SELECT round(median(delta), 9) FROM d WHERE hot) AS median_affected, (SELECT round(median(delta), 9) FROM d) AS median_all,
       (SELECT CASE WHEN count(*) < 30 THEN 'LOW_RISK_RARE_NOT_VALIDATED' WHEN abs(median(delta)) <= 1e-12 THEN 'STABLE_AFFECTED_SUBSET' ELSE 'CHANGED_AFFECTED_SUBSET' END FROM d WHERE hot) AS status""")
def validated_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, both = _runs(spark, sf_dir)
    peaks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("peak")).join(both, "peak", "left_semi")
    met = written(hits.join(peaks, "peak"), "met-hits")
    before, after = (C.over(n, {"base_hits": met}) for n in _TWO)

    def side(hits: DataFrame, recon) -> DataFrame:
        return hits.select(F.col("peak").alias("peak_id"), F.col("hit").alias("hit_id"), F.col("coef").alias("coefficient"), recon.alias("reconstruction"))

    r = validation.stability("d", side(before, F.lit(1.0)), side(after, F.when(F.col("peak") % 4 == 0, 1.0 - 5e-3).otherwise(1.0)))
    discard(hits, met)
    row = (r["n_affected_peaks"], r["n_affected_hits"], round(r["affected_coefficient_share"], 9), round(r["hit_jaccard"], 9), round(r["coefficient_conservation"], 6), round(r["paired_delta_reconstruction_affected"], 9), round(r["paired_delta_reconstruction_all"], 9), r["status"])
    return spark.createDataFrame([row], "n_affected_peaks long, n_affected_hits long, share double, jaccard double, pearson double, median_affected double, median_all double, status string")


@query(_RUNS + """,
m AS (SELECT row_number() OVER (ORDER BY abs(w - o)) AS i, count(*) OVER () AS n, abs(w - o) AS d FROM j WHERE abs(w - o) > 3.63e-07)
SELECT count(*) FILTER (w IS NULL) AS dropped, count(*) FILTER (o IS NULL) AS gained, round(count(*) FILTER (w IS NOT NULL AND o IS NOT NULL) / count(*), 9) AS jaccard, (SELECT count(*) FROM m) AS changed, round(max(abs(w - o)), 9) AS max_delta, (SELECT round(d, 9) FROM m WHERE i = n // 2 + 1) AS upper_median FROM j""")
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, both = _runs(spark, sf_dir)
    before, after = (C.over(n, {"base_hits": hits}) for n in _TWO)
    calls = lambda df: df.select("peak", F.col("hit").alias("motif"), F.lit(0).alias("start"), F.lit("+").alias("strand"), F.col("coef").alias("coefficient"))
    return validation.compare_runs(calls(before), calls(after), both).withColumns({c: F.round(c, 9) for c in ("jaccard", "max_delta", "upper_median")})


@query("""
WITH f AS (SELECT o_orderkey, CAST(('0x' || substr(md5('fold|' || o_orderkey), 1, 8)) AS BIGINT) % 5 AS fold FROM orders)
SELECT 'fold' || fold AS fold_id, count(*) AS evaluated, (SELECT count(*) FROM f) - count(*) AS complement FROM f GROUP BY fold""")
def cross_fit_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds: each peak is evaluated in its own and decides in the others."""
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("fold"), F.col("o_orderkey").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 5
    peaks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("peak_id"), key.alias("own"))
    folds = peaks.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("fold_id"), "peak_id", F.when(F.col("fold") == F.col("own"), "evaluation").otherwise("decision").alias("side"))
    return validation.check_cross_fit(peaks, folds)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS row_id, CASE WHEN i <= 30 THEN 30 WHEN i <= 300 THEN 300 ELSE 900 END AS rung FROM
(SELECT o_orderkey, row_number() OVER (ORDER BY md5('0|' || o_orderkey), CAST(o_orderkey AS VARCHAR)) AS i FROM orders) x WHERE i <= 900""")
def nested_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested seeded subsets of all regions."""
    return validation.ladder(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("row_id")), (30, 300, 900))


_PARTS = """
WITH n AS (SELECT 'n' || p_partkey AS node_id, CASE WHEN p_size % 2 = 0 THEN 'pos' ELSE 'neg' END AS metacluster, CASE WHEN p_size % 3 = 0 THEN 'core' ELSE 'expanded' END AS tier, p_partkey // 5 AS g, p_partkey % 5 AS i, p_size FROM part WHERE p_size % 11 > 0),
rep AS (SELECT g, min(node_id) FILTER (tier = 'core') AS rep, bool_or(p_size > 40) AS doubtful FROM n GROUP BY g HAVING count(*) FILTER (tier = 'core') > 0),
kept AS (SELECT l.lexicon, n.node_id, n.metacluster FROM n JOIN (VALUES ('core'), ('expanded'), ('sensitivity')) AS l(lexicon) ON l.lexicon <> 'core' OR tier = 'core' LEFT JOIN rep ON rep.g = n.g AND NOT (l.lexicon = 'sensitivity' AND doubtful) WHERE rep.rep IS NULL OR rep.rep = n.node_id)"""


def _lexicons(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nodes and collapses of a registry: five neighbours are one cluster, its first core member stands for it."""
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size % 11 > 0").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("node_id"), F.when(F.col("p_size") % 2 == 0, "pos").otherwise("neg").alias("metacluster"), F.when(F.col("p_size") % 3 == 0, "core").otherwise("expanded").alias("analysis_tier"), F.floor(F.col("p_partkey") / 5).alias("g"), "p_size")
    by = nodes.groupBy("g").agg(F.min(F.when(F.col("analysis_tier") == "core", F.col("node_id"))).alias("representative"), F.collect_list("node_id").alias("members"), F.max(F.col("p_size") > 40).alias("threshold_sensitive"))  # five members at most
    decisions = by.filter("representative IS NOT NULL").select(F.col("g").cast("string").alias("cluster_id"), F.lit("collapse").alias("decision"), "representative", "members", F.lit("high").alias("merge_confidence"), F.lit(False).alias("family_ambiguity"), "threshold_sensitive")
    return {x: compiling.members(nodes.drop("g", "p_size"), decisions, x) for x in compiling.LEXICONS}


@query(_PARTS + " SELECT lexicon, node_id, metacluster FROM kept")
def compiled_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [df.select(F.lit(x).alias("lexicon"), "node_id", "metacluster") for x, df in _lexicons(spark, sf_dir).items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query(_PARTS + " SELECT node_id, metacluster, metacluster || '_patterns' AS tag, 'pattern_' || place AS pattern, place FROM (SELECT *, row_number() OVER (PARTITION BY metacluster ORDER BY node_id) - 1 AS place FROM kept WHERE lexicon = 'expanded') x")
def compiled_loading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiling.loading_order(_lexicons(spark, sf_dir)["expanded"]).select("node_id", "metacluster", "tag", "pattern", "place")


@query(_PARTS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY lexicon, metacluster ORDER BY node_id) - 1 AS place FROM kept),
b AS (SELECT coalesce(x.metacluster, y.metacluster) AS metacluster, x.place AS i, y.place AS j FROM (SELECT * FROM o WHERE lexicon = 'core') x FULL JOIN (SELECT * FROM o WHERE lexicon = 'expanded') y ON y.node_id = x.node_id)
SELECT metacluster, count(i) AS n_one, count(j) AS n_other, count(*) FILTER (j IS NULL) AS only_one, count(*) FILTER (i IS NULL) AS only_other, min(coalesce(i, j)) FILTER (i IS DISTINCT FROM j) AS first_difference, count(*) = count(i) AND count(*) = count(j) AS same_set, count(*) FILTER (i IS DISTINCT FROM j) = 0 AS same_order FROM b GROUP BY metacluster""")
def compared_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = _lexicons(spark, sf_dir)
    return compiling.compare_lexicons(compiling.loading_order(lex["core"]), compiling.loading_order(lex["expanded"]))


#: A declared heuristic of the kind that a criteria file holds.
CRITERION = Criterion(
    "NEAR_COPY", "1", HEURISTIC, "TRUE_DUPLICATE", ("overlap_frac_source", "ppm_similarity", "signed_cwm_similarity", "empirical_p_value"),
    (Predicate("overlap_frac_source", "ge", 1.0, "derived", "the whole core", {"evidence_domain": "overlap_frac_source", "endpoint": "max"}), Predicate("ppm_similarity", "ge", 0.9, "declared", "chosen"), Predicate("signed_cwm_similarity", "ge", 0.0, "derived", "same sign", {"evidence_domain": "signed_cwm_similarity", "endpoint": "sign_boundary"})),
    decision_if_matched="collapse", declared_rationale="near copies agree at nine tenths",
)


@query(C.check_sql("criterion_decision").rsplit("SELECT u, v,", 1)[0] + """
SELECT u, v, CASE WHEN empirical_p_value IS NULL THEN 'deferred' WHEN overlap_frac_source >= 1 AND ppm_similarity >= 0.9 AND signed_cwm_similarity >= 0 THEN 'collapse' ELSE 'refuse_merge' END AS outcome,
       'NEAR_COPY v1: ' || CASE WHEN empirical_p_value IS NULL THEN 'missing evidence: empirical_p_value' WHEN overlap_frac_source >= 1 AND ppm_similarity >= 0.9 AND signed_cwm_similarity >= 0 THEN 'all predicates hold'
         ELSE 'not met: ' || concat_ws(', ', CASE WHEN overlap_frac_source < 1 THEN 'overlap_frac_source ge 1.0' END, CASE WHEN ppm_similarity < 0.9 THEN 'ppm_similarity ge 0.9' END, CASE WHEN signed_cwm_similarity < 0 THEN 'signed_cwm_similarity ge 0.0' END) END
       || '; chosen, not derived: ppm_similarity ge 0.9' AS rationale,
       overlap_frac_source >= 1 AND ppm_similarity >= 0.9 AS admitted
FROM evidence""")
def criteria_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = C.run("edges")(spark, sf_dir)
    return edges.select("u", "v", CRITERION.outcome().alias("outcome"), CRITERION.rationale().alias("rationale"), CRITERION.admits({"overlap_frac_source", "ppm_similarity"}).alias("admitted"))


@query("""
WITH hit AS (SELECT l_discount >= 0.02 AS used, l_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
e AS (SELECT p_partkey AS node, p_size FROM part)
SELECT * FROM (VALUES
  ('hits', 'single_scale', true), ('hits', 'four_state_missingness', true),
  ('hits with a zero for an absence', 'four_state_missingness', (SELECT count(*) FROM hit WHERE used IS NOT TRUE) = 0), ('hits of two scales', 'single_scale', (SELECT count(DISTINCT o_orderkey % 2) FROM orders) <= 1),
  ('parts', 'variant_id_unique', true), ('parts by brand', 'variant_id_unique', (SELECT count(DISTINCT p_brand) = count(*) FROM part)),
  ('parts', 'short_motif_flag', true), ('parts, unflagged', 'short_motif_flag', (SELECT count(*) FROM part WHERE p_size <= 6) = 0),
  ('cells', 'estimability_floor', (SELECT min(n) >= 30 FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority) x)), ('cells of days', 'estimability_floor', (SELECT min(n) >= 30 FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderdate) x)),
  ('rules', 'stratum_parity', true), ('rules by size', 'stratum_parity', (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT p_size % 2) AS n FROM part GROUP BY p_brand) x)),
  ('effects', 'comparator_declared', true), ('effects of two sets', 'comparator_declared', (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_orderstatus) x)),
  ('order', 'index_order_matches_loader', true), ('order by price', 'index_order_matches_loader', (SELECT count(*) FILTER (i <> j) = 0 FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS i, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS j FROM part) x)),
  ('summaries', 'no_cross_estimand_pooling', true), ('summaries by brand', 'no_cross_estimand_pooling', (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT p_type) AS n FROM part GROUP BY p_brand) x))
) AS v(subject, guard, passed)""")
def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards over whole tables that are sound and over the same tables with a fault; row guards are watched while a table is written."""
    ship(spark)
    found: list[tuple[str, str, bool]] = []

    def seen(subject: str, df: DataFrame, *watches) -> None:
        w = watch.Watched(df, *watches)
        w.table.write.format("noop").mode("overwrite").save()
        found.extend((subject, v.guard, v.passed) for v in w.verdicts())

    hits = hit_table(spark, sf_dir)
    seen("hits", hits, watch.scale(), watch.four_states())
    seen("hits with a zero for an absence", hits.withColumn("hit_coefficient", F.coalesce("hit_coefficient", F.lit(0.0))), watch.four_states())
    seen("hits of two scales", hits.withColumn("input_scale", F.col("region_id").cast("long") % 2), watch.scale())
    part, orders = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("core_length"), F.lit("homer").alias("source"), F.lit(None).cast("double").alias("q"), F.lit(None).cast("long").alias("seqlet_count"))
    seen("parts", nodes.withColumn("low_confidence_annotation", F.col("core_length") <= 6), watch.weak_flags())
    seen("parts, unflagged", nodes.withColumn("low_confidence_annotation", F.lit(False)), watch.weak_flags())
    cell = lambda *by: orders.groupBy(*by).agg(F.count("*").alias("n")).select(F.concat_ws("/", *by).alias("id"), "n", F.lit("OK").alias("status"), *[F.lit(None).cast("double").alias(c) for c in ("ci_low", "ci_high", "reference")])
    seen("cells", cell("o_orderstatus", "o_orderpriority"), watch.estimable())
    seen("cells of days", cell("o_orderdate"), watch.estimable())
    said = lambda subject, v: found.append((subject, v.guard, v.passed))
    variants = lambda c: part.select(F.col(c).cast("string").alias("variant_id"), F.col("p_partkey").cast("string").alias("denovo_pattern_id"))
    said("parts", variant_id_unique(variants("p_partkey")))
    said("parts by brand", variant_id_unique(variants("p_brand")))
    said("rules", stratum_parity(part.select(F.col("p_brand").alias("variable"), F.lit("one").alias("rule"))))
    said("rules by size", stratum_parity(part.select(F.col("p_brand").alias("variable"), (F.col("p_size") % 2).cast("string").alias("rule"))))
    said("effects", comparator_declared(orders.select(F.col("o_orderstatus").alias("id"), F.lit("O").alias("comparator_id"))))
    said("effects of two sets", comparator_declared(orders.select(F.col("o_orderstatus").alias("id"), F.col("o_orderpriority").alias("comparator_id"))))
    from .selection import placed

    named = part.select(F.col("p_partkey").cast("string").alias("name"), "p_partkey", F.struct("p_retailprice", "p_partkey").alias("price"), F.lit(1).alias("all"))
    order = lambda by: placed(named, "all", by).select("place", "name")
    said("order", index_order_matches_loader(order("p_partkey"), order("p_partkey")))
    said("order by price", index_order_matches_loader(order("p_partkey"), order("price")))
    specs = part.select(F.col("p_partkey").cast("string").alias("cell_id"), F.col("p_type").alias("estimand_id"))
    pooled = lambda c: part.select(F.col(c).alias("group_key"), F.lit(None).cast("string").alias("estimand_id"), F.array(F.col("p_partkey").cast("string")).alias("cell_ids"))
    said("summaries", no_cross_estimand_pooling(pooled("p_type"), specs))
    said("summaries by brand", no_cross_estimand_pooling(pooled("p_brand"), specs))
    return spark.createDataFrame(found, "subject string, guard string, passed boolean")
