"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaygrid.llm import common, langid, minhash, mixing, packing, substring

STAGES = [
    ("language_id", langid.stage),
    ("minhash_near_dedup", minhash.stage),
    ("substring_dedup", substring.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the language model nor the packing of byte-pair ids; tests/llm/test_reference.py plays all five stages plainly and compares run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
