"""Publication of tables by any file system that Spark writes: staged beside their place, then renamed, never over another.

Staging, the rename and its refusal go through Hadoop's FileContext, so a table in an object store or HDFS is published
as one on a local disk is: readers see it whole or not at all, a killed write leaves only a hidden folder beside it, and
a second publication is refused, not merged.  What a table says of itself (schema version, identity, rule) is kept in
the metadata of its columns, inside the Parquet files.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from .readers import Refusal

ABOUT = "about_table"


class Place:
    """One path of one file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.fs = spark, spark._jvm.org.apache.hadoop.fs
        given, conf = self.fs.Path(path), spark._jsc.hadoopConfiguration()
        self.path = given.getFileSystem(conf).makeQualified(given)
        self.context = self.fs.FileContext.getFileContext(self.path.toUri(), conf)

    def __str__(self) -> str:
        return str(self.path.toString())

    def exists(self) -> bool:
        return bool(self.context.util().exists(self.path))

    def beside(self) -> Place:
        """A hidden sibling of a fresh name; Spark's readers of the parent pass over it."""
        return Place(self.spark, f"{self.path.getParent().toString().rstrip('/')}/.{self.path.getName()}-{uuid.uuid4().hex}")

    def make_parent(self) -> None:
        parent = self.path.getParent()
        self.context.mkdir(parent, self.fs.permission.FsPermission.getDirDefault(), True)

    def become(self, target: Place) -> None:
        """Rename, refusing a target that is there."""
        kind = getattr(self.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self.context.rename(self.path, target.path, how)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception) or target.exists():
                raise Refusal(f"{target} is there already") from error
            raise

    def delete(self) -> None:
        with contextlib.suppress(Py4JJavaError):
            self.context.delete(self.path, True)


@contextlib.contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A path to write to; when the block ends well, what is there appears at ``path``."""
    target = Place(spark, path)
    if target.exists():
        raise Refusal(f"{target} is there already")
    stage = target.beside()
    stage.make_parent()
    try:
        yield str(stage)
        stage.become(target)
    finally:
        stage.delete()


def told(df: DataFrame, about: Mapping[str, Any]) -> DataFrame:
    """df whose first column carries what the table says of itself."""
    first, *rest = df.columns
    own = {**df.schema[first].metadata, ABOUT: json.dumps(dict(about), sort_keys=True)}
    return df.select(F.col(f"`{first}`").alias(first, metadata=own), *[F.col(f"`{c}`") for c in rest])


def about(df: DataFrame) -> dict[str, Any]:
    """What a published table says of itself; nothing if it says nothing."""
    for field in df.schema.fields:
        if ABOUT in field.metadata:
            return json.loads(field.metadata[ABOUT])
    return {}


def publish(df: DataFrame, path: str, meta: Mapping[str, Any] | None = None, write: Callable[[DataFrameWriter, str], None] | None = None) -> None:
    """Write a table as Parquet (or by ``write``) and make it appear at its path as one."""
    with staged(df.sparkSession, path) as stage:
        out = (told(df, meta) if meta else df).write
        write(out, stage) if write else out.parquet(stage)


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, whole or not at all, never over another."""
    with staged(spark, path) as stage:
        fs = spark._jvm.org.apache.hadoop.fs
        at = fs.Path(stage)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
