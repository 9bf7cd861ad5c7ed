"""Exact ranks and medians of any column, however its values are spread.

Equal values are counted first, so a frequent value is one row.  Distinct values are dealt by sampled range, which
outliers cannot stretch, and written; a value's rank is its running count inside its range plus what the ranges before
it hold, of which there is one number each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import written


def counted(df: DataFrame, grp, value) -> DataFrame:
    """grp, delta, n of the values that are not null."""
    return df.select(grp.alias("grp"), value.alias("delta")).filter("delta IS NOT NULL").groupBy("grp", "delta").agg(F.count("*").alias("n"))


def ranked(values: DataFrame) -> DataFrame:
    """grp, delta, n, upto (values of the group up to delta), total, of distinct (grp, delta) with their counts n."""
    dealt = written(values.select("grp", "delta", F.col("n").cast("long").alias("n")).repartitionByRange("grp", "delta").withColumn("part", F.spark_partition_id()), "ranges")
    own = W.partitionBy("grp", "part").orderBy("delta")
    sums = dealt.groupBy("grp", "part").agg(F.sum("n").alias("held"))
    before = sums.select("grp", "part", (F.sum("held").over(W.partitionBy("grp").orderBy("part")) - F.col("held")).alias("ahead"), F.sum("held").over(W.partitionBy("grp")).alias("total"))
    running = dealt.withColumn("upto", F.sum("n").over(own))
    met = running.alias("r").join(before.alias("b"), F.col("r.grp").eqNullSafe(F.col("b.grp")) & (F.col("r.part") == F.col("b.part")))
    return met.select("r.grp", "r.delta", "r.n", (F.col("r.upto") + F.col("b.ahead")).alias("upto"), "b.total")


def medians(values: DataFrame) -> DataFrame:
    """grp, lower, upper, middle (their mean) of each group of (grp, delta, n); a group without values has no row."""
    holds = lambda i: F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("n") <= i), F.col("delta")))
    ends = ranked(values).groupBy("grp").agg(holds(F.floor((F.col("total") - 1) / 2)).alias("lower"), holds(F.floor(F.col("total") / 2)).alias("upper"))
    return ends.withColumn("middle", (F.col("lower") + F.col("upper")) / 2)


def placed(df: DataFrame, by: str, order: str, name: str = "place") -> DataFrame:
    """df with each row's place (from 0) among the rows of its ``by`` in the order of ``order``, whose values are distinct there."""
    dealt = written(df.repartitionByRange(by, order).withColumn("__part", F.spark_partition_id()), "placed")
    sums = dealt.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = sums.withColumn("__ahead", F.sum("__n").over(W.partitionBy("__by").orderBy("__p")) - F.col("__n")).drop("__n")
    own = dealt.withColumn("__i", F.row_number().over(W.partitionBy(by, "__part").orderBy(order)))
    met = own.join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    return met.withColumn(name, F.col("__ahead") + F.col("__i") - 1).select(*df.columns, name)
