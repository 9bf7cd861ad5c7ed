"""Tables appear whole or not at all, never over another, and say what they are."""

import os

import pytest
from pyspark.sql import functions as F

from assaygrid.sources import publish, sinks
from assaygrid.sources.readers import Refusal


def test_a_table_appears_once_and_says_what_it_is(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/t"
    df = spark.range(5).select("id", (F.col("id") * 2).alias("twice"))
    publish.publish(df, path, {"schema_version": "1", "rule": "é"})
    back = spark.read.parquet(path)
    assert publish.about(back) == {"schema_version": "1", "rule": "é"} and publish.about(df) == {} and sorted(map(tuple, back.collect())) == [(i, 2 * i) for i in range(5)]
    with pytest.raises(Refusal, match="there already"):
        publish.publish(df.limit(1), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path / "deep" / "er") == ["t"]


def test_a_write_that_dies_leaves_no_table(spark, tmp_path):
    """A task fails after others have written their files."""
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") < 39, F.col("id")).otherwise(F.raise_error(F.lit("died"))).cast("long").alias("x"))
    with pytest.raises(Exception, match="died"):
        publish.publish(bad, str(tmp_path / "t"))
    assert os.listdir(tmp_path) == []
    publish.publish(spark.range(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_two_writers_of_one_place(spark, tmp_path):
    """Both see no table and write; the second rename is refused and the first table stays."""
    with publish.staged(spark, str(tmp_path / "t")) as first:
        spark.range(3).write.parquet(first)
        with pytest.raises(Refusal, match="there already"):
            with publish.staged(spark, str(tmp_path / "t")) as second:
                spark.range(7).write.parquet(second)
                os.rename(first.removeprefix("file:"), tmp_path / "t")
        os.rename(tmp_path / "t", first.removeprefix("file:"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and sorted(os.listdir(tmp_path)) == ["t"]


def test_text_and_edges(spark, tmp_path):
    publish.publish_text(spark, str(tmp_path / "a.json"), "{}\n")
    with pytest.raises(Refusal):
        publish.publish_text(spark, str(tmp_path / "a.json"), "[]")
    assert (tmp_path / "a.json").read_text() == "{}\n"
    edges = spark.createDataFrame([("a", "b")], "source_node_id string, target_node_id string").withColumns({c: F.lit(None).cast(t) for c, t in list(sinks.EDGES.items())[2:]})
    sinks.write_edges(edges, str(tmp_path / "e"), {"seed": 3})
    assert publish.about(spark.read.parquet(str(tmp_path / "e"))) == {"schema_version": "1", "seed": 3}
    with pytest.raises(Refusal):
        sinks.write_edges(edges, str(tmp_path / "e"))
