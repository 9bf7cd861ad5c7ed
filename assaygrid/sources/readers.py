"""Hit tables and region sets as validated DataFrames.

A hit table says of every searched opportunity which of four things happened; absence is a state, never 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIT = T.StructType(
    [
        T.StructField("region_id", T.StringType()), T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("variant_id", T.StringType()), T.StructField("family_id", T.StringType()), T.StructField("hit_coefficient", T.DoubleType()), T.StructField("missingness", T.StringType()),
        T.StructField("input_scale", T.LongType()), T.StructField("lexicon_id", T.StringType()), T.StructField("substrate_id", T.StringType()),
    ]
)
#: The four states of an opportunity.
STATES = ("not_searched", "no_sequence_match", "hit_below_floor", "used")
#: Spellings of an absent cell.
BLANK = ("", "nan", "NaN", "NAN", "NA", "N/A", "None", "none", "null", "NULL", "<NA>", "NaT")


class Refusal(ValueError):
    """An input or a claim that the engine declines, with the reason."""


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit table from Parquet (.parquet, .pq) or else from tab-separated text with a header; both read alike."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    missing = [f.name for f in HIT if f.name not in raw.columns]
    if missing:
        raise Refusal(f"{path}: missing columns {', '.join(missing)}")
    text = lambda c: F.when(~F.trim(F.col(c).cast("string")).isin(*BLANK), F.col(c).cast("string"))
    out = raw.select(*[text(f.name).alias(f.name) if f.dataType == T.StringType() else F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in HIT])
    return out.withColumn("hit_coefficient", F.when(~F.isnan("hit_coefficient"), F.col("hit_coefficient")))


def check_hits(hits: DataFrame) -> DataFrame:
    """The same table, refused unless every row and the table as a whole keep the contract (one pass)."""
    used = F.col("missingness") == "used"
    named = F.col("family_id").isNotNull() & F.col("variant_id").isNotNull() & F.col("hit_coefficient").isNotNull()
    bad = (
        F.col("region_id").isNull() | F.col("chrom").isNull() | F.coalesce(F.col("start") >= F.col("end"), F.lit(True))
        | ~F.coalesce(F.col("missingness").isin(*STATES), F.lit(False)) | (used & ~named) | (~used & F.col("hit_coefficient").isNotNull())
    )
    one = ("input_scale", "lexicon_id", "substrate_id")
    row = hits.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), *[F.count_distinct(c).alias(c) for c in one]).first()
    if not row.n:
        raise Refusal("the hit table is empty")
    if row.bad:
        first = hits.filter(F.coalesce(bad, F.lit(True))).limit(1).first()
        raise Refusal(f"{row.bad} rows of the hit table break its contract; one is {first.asDict()}")
    for c in one:
        if row[c] != 1:
            raise Refusal(f"the hit table has {row[c]} values of {c}, not one")
    return hits


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """ordinal and region_id of a region set: a list of ids, or BED (fourth field, or chrom:start-end); first of repeated ids."""
    line = F.trim("value")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), line.alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").rlike("^(#|track|browser)"))
    f = F.split("line", r"\s+")
    region = F.when(F.size(f) >= 4, f[3]).when(F.size(f) == 3, F.concat(f[0], F.lit(":"), f[1], F.lit("-"), f[2])).otherwise(f[0])
    out = lines.select("ordinal", region.alias("region_id")).groupBy("region_id").agg(F.min("ordinal").alias("ordinal"))
    if not out.take(1):
        raise Refusal(f"{path}: no regions")
    return out.select("ordinal", "region_id")
