"""Mixing sources to target weights by capped water-filling.

Every source's share of the mixture follows its weight until the source would be read more than
``max_epochs`` times; it is clamped there and the excess goes to the others in proportion to their
weights, until no source is above its cap.  A document is then taken as many whole times as its source's
ratio has whole epochs; the fractional epoch is a seeded sample without replacement: documents in the order
of a seeded hash, until their words reach the fraction (to the nearest document).

The order's running sum is made in two steps: over 4,096 hash buckets of each source, then within the one
bucket in which the fraction ends, so a source with a third of all rows is not gathered in one task.  The
sample is then a comparison with its last hash; texts are never shuffled.  A few numbers for each source
come to the driver.

Defined cases: null text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; sources of size 0 have target 0; a null id hashes as the empty text; rows with the same id and size
are sampled together or not at all; an empty table gives an empty result.  Extra columns pass through, and
the result's names win over input columns of the same names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

CYCLE = (3, 1, 2)
SEED = 17
BUCKET_DIGITS = 3  # hexadecimal digits of the hash that name a bucket


def water_fill(sizes: list[int], weights: list[Fraction], share: Fraction, max_epochs: Fraction) -> tuple[list[Fraction], list[bool]]:
    """Targets that sum to share of all sizes (or as near as caps allow), and which of them are at their cap."""
    n = len(sizes)
    caps = [max_epochs * z for z in sizes]
    targets, clamped = [Fraction(0)] * n, [False] * n
    left = share * sum(sizes)
    while True:
        free = [i for i in range(n) if not clamped[i]]
        total = sum(weights[i] for i in free)
        if not free or not total:
            return targets, clamped
        over = []
        for i in free:
            targets[i] = left * weights[i] / total
            if targets[i] >= caps[i]:
                over.append(i)
        if not over:
            return targets, clamped
        for i in over:
            targets[i], clamped[i] = caps[i], True
            left -= caps[i]


def mix(docs: DataFrame, share: str = "1.5", max_epochs: int = 2, seed: int = SEED, weights: dict[str | None, int] | None = None) -> DataFrame:
    """docs with size, source_size, target, copies (whole and sampled repetitions) and taken (copies * size)."""
    spark = docs.sparkSession
    names = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*names, "__rank", "__s")
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    bucket = F.substring("__rank", 1, BUCKET_DIGITS)
    sized = common.written(docs.select(F.col("source").cast("string").alias("source"), size.alias("size"), rank.alias("__rank")), "mixing-sizes")
    buckets = common.written(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n")), "mixing-buckets")
    totals = {r[0]: r[1] for r in buckets.groupBy("source").agg(F.sum("n")).collect()}  # one number for each source
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    given = [Fraction((weights or {}).get(s, CYCLE[i % 3])) for i, s in enumerate(order)]
    targets, clamped = water_fill([totals[s] for s in order], given, Fraction(share), Fraction(max_epochs))
    rows = []
    for s, t, full in zip(order, targets, clamped, strict=True):
        whole = max_epochs if full else int(t // totals[s]) if totals[s] else 0
        rows.append((s, totals[s], round(float(t), 6), whole, round(float(t - whole * totals[s]), 6)))
    plan = spark.createDataFrame(rows, "__s string, source_size long, target double, __whole int, __rest double")
    edges = boundaries(sized, buckets, plan, bucket)
    full_plan = spark.createDataFrame([(*r, *edges.get(r[0], ("", -1))) for r in rows], plan.schema.add("__edge_rank", "string").add("__edge_size", "long"))
    # one row for each source, all of which the driver has just seen
    marked = docs.withColumns({"size": size, "__rank": rank}).join(F.broadcast(full_plan), F.col("source").cast("string").eqNullSafe(F.col("__s")))
    sampled = F.struct("__rank", "size") <= F.struct("__edge_rank", "__edge_size")
    copies = F.col("__whole") + sampled.cast("int")
    return marked.select(*docs.columns, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def boundaries(sized: DataFrame, buckets: DataFrame, plan: DataFrame, bucket: Column) -> dict[str | None, tuple[str, int]]:
    """For each source the last (hash, size) of its sample: documents up to it hold the fraction's words.

    The bucket in which the fraction ends is found from the buckets' sums; only its documents are ordered.
    """
    upto = F.sum("n").over(W.partitionBy("source").orderBy("bucket"))  # 4,096 rows a source
    running = buckets.select("source", "bucket", upto.alias("upto"), (upto - F.col("n")).alias("before"))
    last = running.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__s"))).withColumn("rest", F.col("__rest")).filter("before <= rest AND rest > 0").groupBy("source").agg(F.max_by(F.struct("bucket", "before", "rest"), "bucket").alias("e"))
    e = last.select(F.col("source").alias("s"), "e.*")
    inside = sized.join(F.broadcast(e), F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("bucket")))  # one row for each source
    # rows of one hash and size stand together: a repeated (or null) id is one row of the window for each of its sizes
    inside = inside.groupBy("source", "__rank", "size", "bucket", "before", "rest").agg(F.count("*").alias("m"))
    through = F.col("before") + F.sum(F.col("size") * F.col("m")).over(W.partitionBy("source").orderBy("__rank", "size"))
    taken = inside.select("source", "__rank", "size", "bucket", through.alias("through"), "rest").filter(F.col("through") - F.col("size") / 2 <= F.col("rest"))
    edge = {r[0]: (r[1].r, r[1].z) for r in taken.groupBy("source").agg(F.max(F.struct(F.col("__rank").alias("r"), F.col("size").alias("z")))).collect()}
    # where no document of the boundary's bucket is taken, the sample ends before that bucket
    return {r[0]: edge.get(r[0], (r[1], -1)) for r in e.select("s", "bucket").collect()}


def op7_water_filled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''))) AS r
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
w AS (SELECT source, z, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
k AS (SELECT *, sum(2 * z) OVER o AS caps, sum(w) OVER o AS ws FROM w WINDOW o AS (ORDER BY 2 * z / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT 1.5 * sum(z) AS total, sum(w) AS allw FROM w),
l AS (SELECT greatest((SELECT total / allw FROM t), coalesce(max((total - caps) / nullif(allw - ws, 0)), 0)) AS level FROM k, t),
p AS (SELECT source, z, round(least(2.0 * z, level * w), 6) AS target,
             CASE WHEN level * w >= 2.0 * z THEN 2 WHEN z = 0 THEN 0 ELSE CAST(floor(level * w / z) AS INT) END AS whole,
             level * w AS goal FROM w, l),
o AS (SELECT d.*, p.z AS source_size, p.target, p.whole,
             CASE WHEN p.whole = 2 THEN 0 ELSE round(p.goal - p.whole * p.z, 6) END AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.r, d.size) AS through
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((whole + CASE WHEN rest > 0 AND through - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as many times as the mixture takes it, as rows of their own."""
    docs, restore = common.apart(docs, ("size", "source_size", "target", "copies", "taken"))
    return restore(mix(docs).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))))
