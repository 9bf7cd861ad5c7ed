"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text.  A text is cut into
chunks of ``chunk`` bytes, each compressed on its own with either dictionary; the difference of the two
compressed sizes, divided by the text's own size, says which kind of text it resembles.  The difference
is turned into a calibrated score by isotonic regression on labelled texts that built no dictionary.

Dictionaries and calibration come from about ``texts_per_class`` labelled texts of each class (a documented
bound); scoring covers every row and every whole text.

Defined cases: null and empty texts have difference 0 and the score that belongs to it; without labelled
texts of both classes every score is the share of good labels (0.5 without labels).  Labels that are null
or belong to no document are ignored; of repeated label rows each counts.  Repeated rows score alike.
A very long text is read whole, chunk by chunk; an empty table gives an empty result.  Input columns named
like the result's come back as ``__was_<name>``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FEW = 8


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    chunk: int
    level: int
    knots: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    prior: float = 0.5

    def scorer(self):
        if not self.good or not self.bad:
            return lambda text: (0.0, self.prior)
        tools = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=self.level)
            tools.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
        good, bad = tools
        knots, values, chunk = np.array(self.knots), np.array(self.values), self.chunk

        def score(text: str | None) -> tuple[float, float]:
            b = (text or "").encode("utf-8", "replace")
            diff = sum(len(bad.compress(b[i : i + chunk])) - len(good.compress(b[i : i + chunk])) for i in range(0, len(b), chunk))
            x = diff / max(1, len(b))
            return x, float(np.interp(x, knots, values)) if len(knots) else self.prior

        return score


def isotonic(x: np.ndarray, y: np.ndarray, least: int = 20) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing fit of y on x (pool adjacent violators, over runs of ``least`` points)."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    pools: list[list[float]] = []  # sum of x, sum of y, count
    for i in range(0, len(x), least):
        pools.append([x[i : i + least].sum(), y[i : i + least].sum(), len(x[i : i + least])])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools], [(p[1] + 0.5) / (p[2] + 1) for p in pools]


def train(rows: list[tuple[str, int]], chunk: int = 1024, level: int = 3, dict_bytes: int = 32768) -> CompressionModel:
    """Model from (text, label) pairs: even places build the dictionaries, odd places calibrate."""
    prior = sum(y for _, y in rows) / len(rows) if rows else 0.5
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for i, (t, y) in enumerate(rows):
        if i % 2 == 0:
            b = t.encode("utf-8", "replace")
            parts[y] += [b[j : j + chunk] for j in range(0, len(b), chunk)]
    raws = []
    for y in (1, 0):
        own = [p for p in parts[y] if len(p) >= 16]
        if len(own) < FEW:
            return CompressionModel(b"", b"", chunk, level, prior=prior)
        total = sum(map(len, own))
        try:
            raws.append(zstandard.train_dictionary(min(dict_bytes, max(1024, total // 4)), own).as_bytes())
        except zstandard.ZstdError:
            raws.append(b"".join(own)[-dict_bytes:])  # too little text to train on: the text itself is the dictionary
    model = CompressionModel(raws[0], raws[1], chunk, level, prior=prior)
    score = model.scorer()
    held = [(score(t)[0], y) for i, (t, y) in enumerate(rows) if i % 2]
    if held:
        model.knots, model.values = isotonic(np.array([x for x, _ in held]), np.array([y for _, y in held]), least=max(1, min(20, len(held) // 5)))
    return model


def fit(docs: DataFrame, labels: DataFrame, texts_per_class: int = 3000, seed: int = 5, label: str = "quality", **how) -> CompressionModel:
    """Model from docs (doc_id, text) and labels (doc_id, label), both already cut to the learnable rows; texts of more than ``common.LEARN_BYTES`` teach nothing."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    sample = common.bounded_sample(known, "y", texts_per_class, F.col("doc_id"), seed)
    rows = docs.select("doc_id", "text").filter((F.col("text") != "") & (F.octet_length("text") <= common.LEARN_BYTES)).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
    rows = common.at_most_of(rows, "y", 2 * texts_per_class, seed).collect()  # an id of many documents or labels would swell the sample
    rows.sort(key=lambda r: (zlib.crc32(f"{seed}|{r.doc_id}".encode()), r.doc_id, r.text, r.y))
    return train([(r.text, r.y) for r in rows], **how)


def predict(docs: DataFrame, model: CompressionModel, text: str = "text") -> DataFrame:
    """docs with diff (normalised difference of compressed sizes, higher: better) and score (0 to 1)."""
    common.prepare(docs.sparkSession)
    docs, _ = common.apart(docs, ("diff", "score"))
    kept = [f.name for f in docs.schema]
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = [score(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64())], names=[*kept, "diff", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("diff", T.DoubleType()), T.StructField("score", T.DoubleType())]))


def op10_compression_quality(spark: SparkSession, sf_dir: str, at_least: float = 0.3) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    common.prepare(spark)
    model = fit(docs, labels.filter(common.id_crc() % 5 != 0))
    out = predict(docs, model)
    return out.select("doc_id", (common.id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"), "diff")
