"""Substring deduplication with a compressed FM-index for each shard.

A passage is a window of ``window`` consecutive words of one document.  Every word covered by a window that
also starts anywhere else, in another document or in the same, is removed; windows are judged on the input.

1. Each window has an anchor: of its runs of ``run`` words, the one with the least hash (the leftmost of
   equals).  Equal windows have equal anchors, so only anchors that occur at least twice matter; one row
   holds a stretch of windows with the same anchor.  Rows of one anchor are dealt over ``SALTS`` parts, by
   their place in the written table, so a very common anchor is counted and joined in many tasks.
2. The stretch's words, a segment, go to the shard of its anchor.  Equal segments are summed before the
   shuffle and carry their number.  Where an anchor occurs more than ``hot`` times, each window is a segment
   of its own and goes to the shard of its own hash, so one very common passage is spread over all shards.
3. A shard indexes its segments (wavelet tree over the transform of their word sequences) and streams them
   through backward search: matching statistics of at least ``window`` words with two or more occurrences,
   or a segment that stands for several, are reported as intervals.
4. A document's intervals are united and its other words kept.

Equal texts are one text with a number.  All windows of all documents are judged; nothing is capped.

Defined cases: null text has no words; texts shorter than a window keep all words; equal ids and repeated
rows are judged as documents of their own; an empty table gives an empty result; extra columns pass
through ``remove``, whose names win over input columns of the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .fmindex import FMIndex
from .words import hashed, runs

WINDOW, RUN = 35, 6
HOT = 4000
SALTS = 32
SHARD_WORDS = 400_000


def least(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    out, size = values, 1
    while 2 * size <= n:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < n:
        out = np.minimum(out[: len(out) - (n - size)], out[n - size :])
    return out


def anchors(texts: list[str | None], window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, anchor, first and last window start of every stretch of windows with one anchor."""
    found = []
    for block in hashed(texts):
        n = len(block.hashes)
        if n < window:
            continue
        grams = runs(block.hashes, run)
        place = np.arange(len(grams), dtype=np.uint64)
        shift = np.uint64(max(21, int(len(grams)).bit_length()))
        packed = ((grams >> shift) << shift) | place
        at = (least(packed, window - run + 1) & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        text = np.repeat(np.arange(len(block.texts)), np.diff(block.first))
        start = np.arange(n - window + 1)
        good = text[start] == text[start + window - 1]
        start, at, text = start[good], at[good], text[start[good]]
        if not len(start):
            continue
        head = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        last = np.append(head[1:], len(start)) - 1
        offset = block.first[text[head]]
        found.append((np.array(block.texts)[text[head]], grams[at[head]].view(np.int64), start[head] - offset, start[last] - offset))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, anchor, a, b = anchors(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_pydict({"key": batch.column(0).take(pa.array(text)), "anchor": pa.array(anchor), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})


def _plain(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _split_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without a candidate are finished here; the others go on with their text."""
    for batch in batches:
        key, m, text, spots = batch.columns
        words, sha, kept = [], [], []
        for t, s in zip(text.to_pylist(), spots.is_valid().to_pylist(), strict=True):
            w = t.encode("utf-8", "replace").split()
            words.append(len(w))
            sha.append(None if s else _plain(w))
            kept.append(t if s else None)
        yield pa.RecordBatch.from_arrays([key, m, pa.array(kept, pa.string()), spots, pa.array(words, pa.int64()), pa.array(sha, pa.string())], names=["key", "m", "text", "spots", "n_words", "sha"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, m, text, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode("utf-8", "replace").split()
            route, start, seg = [], [], []
            for s in spots:
                a, b, r = s["a"], s["b"], s["anchor"]
                if s["total"] > HOT:
                    for j in range(a, b + 1):
                        w = b" ".join(words[j : j + WINDOW])
                        route.append(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True))
                        start.append(j)
                        seg.append(w)
                else:
                    route.append(r)
                    start.append(a)
                    seg.append(b" ".join(words[a : b + WINDOW]))
            n = len(seg)
            yield pa.RecordBatch.from_pydict({"route": pa.array(route, pa.int64()), "seg": pa.array(seg, pa.binary()), "seg_key": pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in seg], pa.binary()), "m": pa.array([m] * n, pa.int64()), "key": pa.array([key] * n, pa.binary()), "start": pa.array(start, pa.int32())})


def shard_intervals(segments: list[bytes], numbers: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the segment, first word and end of the interval covered by windows that occur again."""
    ids: dict[bytes, int] = {}
    seqs = [np.array([ids.setdefault(w, len(ids) + 1) for w in s.split(b" ")], dtype=np.int64) for s in segments]
    lens = np.array([len(s) for s in seqs], dtype=np.int64)
    index = FMIndex(seqs)
    low, high = np.zeros(len(seqs), np.int64), lens - window
    single = np.flatnonzero(numbers < 2)  # the others occur again as a whole
    low[single], high[single] = index.repeated_span(single, lens[single], window)
    found = np.flatnonzero(low >= 0)
    return found, low[found], high[found] + window


def _search(pdf):
    import pandas as pd

    at, low, end = shard_intervals(pdf.seg.tolist(), pdf.m.to_numpy())
    return pd.DataFrame({"seg_key": pdf.seg_key.to_numpy()[at], "low": low.astype(np.int32), "end": end.astype(np.int32)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n_words, n_removed, sha, kept (the new text; null where nothing was removed)."""
    for batch in batches:
        key, text, n, sha, spans = batch.columns
        removed, digest, kept = [], [], []
        for t, s, own in zip(text.to_pylist(), sha.to_pylist(), spans.to_pylist(), strict=True):
            if t is None or not own:
                removed.append(0)
                digest.append(s if t is None else _plain(t.encode("utf-8", "replace").split()))
                kept.append(None)
                continue
            words = t.encode("utf-8", "replace").split()
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, [x["low"] for x in own], 1)
            np.add.at(edge, [x["end"] for x in own], -1)
            gone = np.cumsum(edge)[:-1] > 0
            left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            removed.append(int(gone.sum()))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([key, n, pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["key", "n_words", "n_removed", "kept_sha256", "kept"])


def repeated(docs: DataFrame) -> DataFrame:
    """One row for each distinct text of docs (doc_id, text): key, n_words, n_removed, kept_sha256, kept."""
    common.prepare(docs.sparkSession)
    keyed = docs.filter(F.col("text").isNotNull()).select(common.text_key().alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    found = keyed.select("key", "text").mapInArrow(_anchor_rows, "key binary, anchor long, a int, b int")
    found = common.written(found.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("byte")), "anchors")
    again = found.groupBy("anchor", "salt").count()
    again = again.select("anchor", "salt", F.sum("count").over(Window.partitionBy("anchor")).alias("total")).filter("total > 1")
    spots = found.join(again, ["anchor", "salt"]).groupBy("key").agg(F.collect_set(F.struct("anchor", "a", "b", "total")).alias("spots"))  # at most a text's own stretches
    spots = common.written(spots, "spots")
    common.discard(found)
    texts = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("id"))
    first = texts.join(spots, "key", "left")
    rows = keyed.alias("d").join(first.alias("f"), (F.col("d.key") == F.col("f.key")) & (F.col("d.id") == F.col("f.id")))
    kind = spots.schema["spots"].dataType.simpleString()
    rows = rows.select("d.key", "m", "text", "spots").mapInArrow(_split_off, f"key binary, m long, text string, spots {kind}, n_words long, sha string")
    rows = common.written(rows, "candidates")
    common.discard(spots)
    segments = common.written(rows.filter("spots IS NOT NULL").select("key", "m", "text", "spots").mapInArrow(_segments, "route long, seg binary, seg_key binary, m long, key binary, start int"), "segments")
    distinct = common.written(segments.groupBy("route", "seg_key", "seg").agg(F.sum("m").alias("m")), "distinct-segments")
    total = distinct.agg(F.sum(F.length("seg"))).first()[0] or 0
    shards = max(1, -(-total // (6 * SHARD_WORDS)))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).select("shard", "seg_key", "seg", "m")
    hits = common.written(dealt.groupBy("shard").applyInPandas(_search, "seg_key binary, low int, end int"), "intervals")
    common.discard(distinct)
    spans = segments.select("seg_key", "key", "start").join(hits, "seg_key").select("key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("end")).alias("end"))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("low", "end")).alias("spans"))
    out = rows.join(spans, "key", "left").select("key", "text", "n_words", "sha", "spans").mapInArrow(_cut, "key binary, n_words long, n_removed long, kept_sha256 string, kept string")
    out = common.written(out, "cut")
    common.discard(segments, hits, rows)
    return out


def remove(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept (the text that is left; null where it is unchanged)."""
    names = ("n_words", "n_removed", "kept_sha256", "kept")
    docs = docs.drop(*names, "__key")
    cut = repeated(docs.select("doc_id", "text")).dropDuplicates(["key"]).withColumnRenamed("key", "__cut")
    out = docs.withColumn("__key", common.text_key()).join(cut, F.col("__key") == F.col("__cut"), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(*docs.columns, F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", F.lit(empty)).alias("kept_sha256"), "kept")


def op2_fm_index_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeated(docs).select("key", "n_words", "n_removed", "kept_sha256").distinct()
    out = docs.select("doc_id", common.text_key().alias("k")).join(cut, F.col("k") == F.col("key"), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", F.lit(empty)).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the words that repeat elsewhere; unchanged texts stay as they are."""
    docs, restore = common.apart(docs, ("n_words", "n_removed", "kept_sha256", "kept"))
    return restore(remove(docs).withColumn("text", F.coalesce("kept", "text")))
