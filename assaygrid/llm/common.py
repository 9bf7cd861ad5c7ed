"""Helpers shared by the corpus operators: shipping code, shared scratch tables, ordered streams.

Intermediate tables are the engine's (``sources.scratch``): written to the folder named by
``spark.checkpoint.dir``; where that setting is absent, a local session gets a folder of its own and a cluster
is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import discard, drop_scratch, scratch_dir, setting, ship, written  # noqa: F401

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch sent to Python: texts can be long, so batches are small.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Bytes of a text from which a classifier may learn, so that a sample of a bounded number of rows is bounded in bytes.
LEARN_BYTES = 1 << 15


def prepare(spark: SparkSession) -> SparkSession:
    """Send this package to the executors (once per context) and keep Arrow batches small.

    The two settings of the session stay lowered: plans are made when the caller runs the result, not here.
    """
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, str(most + 1))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, names: tuple[str, ...]):
    """docs with columns of these names renamed, and a function that gives a result docs' own columns back."""
    old = docs.columns
    new = [f"__was_{c}" if c.lower() in names else c for c in old]
    return docs.toDF(*new), lambda df: df.select(*[F.col(f"`{n}`").alias(o) for n, o in zip(new, old, strict=True)])


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_key(col: str = "text") -> Column:
    """16-byte key of a whole text (null: null)."""
    return F.unhex(F.md5(F.col(col).cast("binary")))


def bounded_sample(df: DataFrame, by: str, at_most: int, key: Column, seed: int) -> DataFrame:
    """Rows whose seeded hash is among the smallest of their class, about at_most for each value of ``by``.

    A fraction is fixed from the class's own count, so the sample stays bounded as the input grows, and a
    class with at most at_most rows is kept whole.  Rows of one key are drawn together; where such a key is
    hot, the class is cut to twice at_most rows.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    cut = None
    for value, n in counts.items():
        share = min(1.0, at_most / n)
        cond = (F.col(by) == F.lit(value)) & (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003)) < F.lit(round(share * 1_000_003)))
        cut = cond if cut is None else cut | cond
    return at_most_of(df.filter(cut if cut is not None else F.lit(False)), by, 2 * at_most, seed)


def at_most_of(df: DataFrame, by: str, most: int, seed: int) -> DataFrame:
    """At most about ``most`` rows of each value of ``by``, dealt by a seeded hash into slots of 200 rows at most.

    A class of half as many rows fills its slots to about a half, and so stays whole; equal rows share a slot.
    """
    slots = max(1, most // 200)
    drawn = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    place = F.row_number().over(W.partitionBy(by, F.pmod(drawn, F.lit(slots))).orderBy(F.xxhash64(F.lit(seed + 1), drawn)))
    return df.withColumn("__place", place).filter(F.col("__place") <= -(-most // slots)).drop("__place")
