"""Tables written once and read back: they cut lineage, survive a lost executor and are shared by later steps.

They lie in the folder that ``spark.checkpoint.dir`` names; a local session without it gets a folder of its own,
a cluster is refused.  Code that runs in Python workers is shipped to them first.
"""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: While a table is written, its shuffle files go as soon as the write ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _archive() -> str:
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Executors import this package from a zip file that the driver serves."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_archive())
        _shipped.add(app)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session while a block runs; the caller's value comes back after it."""
    held = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


@contextlib.contextmanager
def one_thread(spark: SparkSession):
    """Python functions that are put into plans while a block runs get workers whose BLAS has one thread: each core has a task already."""
    env = spark.sparkContext.environment
    held = {k: env.get(k) for k in ("OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}
    env.update(dict.fromkeys(held, "1"))
    try:
        yield
    finally:
        for k, v in held.items():
            env.pop(k) if v is None else env.update({k: v})


@functools.cache
def _own_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="scratch-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in a local session without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return named or _own_scratch()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


_paths: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, name), df.schema
    with setting(spark, CLEAN, "true"):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        _, path = _paths.pop(id(df), (None, None))
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table that ``written`` made; call it once the results have been stored."""
    _paths.clear()
    _delete(spark, f"{scratch_dir(spark).rstrip('/')}/tables")


@contextlib.contextmanager
def progress(spark: SparkSession, said: Callable[[int, int], None], every: float = 1.0):
    """While a block runs, ``said(done, total)`` hears of the tasks of the stages that are under way."""
    over, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def watch() -> None:
        while not over.wait(every):
            stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
            said(sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages))

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
