"""Packing with a controlled mixture: deficit round-robin over source queues.

Each source is a queue of its documents' ids, in ascending document id.  Rounds are mixing windows of
``window`` ids: in each, a source's deficit grows by its quantum, window times its share of the sources
that still have ids, and the whole ids of the deficit are sent; the fraction is carried to the next window.
Windows follow each other without a gap and are cut into sequences of ``length`` ids, so that only the last
sequence of all is padded (to a power of two).

Because a queue's deficit after w windows has a closed form, ids sent = floor(base + rate * w) with exact
integers, no window waits for the one before: a partition that knows how many ids of a source stand before
it places its own documents, and deficits carry over partitions as over windows.  When a source runs
dry the rest share its quantum (a new phase, worked out once from the totals of the sources).

Target shares are given as weights; without them each source's share is its share of all ids, so every
window has the mixture of the whole and all queues end together.

Defined cases: null text is the empty text (only the end id); a null source is a source of its own, last;
equal ids and repeated rows are packed each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common
from .tokens import encoder, in_order, together, tokenizer_path

#: Rows of the offsets table (partitions x sources) up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


class Schedule:
    """Ids sent by each queue after any number of windows, and the place of any id; exact integers."""

    def __init__(self, totals: list[int], weights: list[Fraction], window: int):
        self.totals, self.window = totals, window
        n = len(totals)
        left, at = [Fraction(t) for t in totals], Fraction(0)
        self.starts: list[Fraction] = []  # where each phase begins, in windows
        self.lines: list[list[tuple[int, int, int]]] = []  # a, b, d: (a + b * w) // d ids sent
        self.base: list[list[Fraction]] = []
        while any(left):
            active = [i for i in range(n) if left[i]]
            total = sum(weights[i] for i in active)
            rate = [window * weights[i] / total if left[i] else Fraction(0) for i in range(n)]
            sent = [totals[i] - left[i] for i in range(n)]
            step = min(left[i] / rate[i] for i in active)
            lines = []
            for i in range(n):
                const = sent[i] - rate[i] * at
                d = const.denominator * rate[i].denominator
                lines.append((const.numerator * rate[i].denominator, rate[i].numerator * const.denominator, d))
            self.starts.append(at)
            self.lines.append(lines)
            self.base.append(sent)
            at += step
            left = [max(Fraction(0), left[i] - rate[i] * step) for i in range(n)]
        self.end = at
        self.known: dict[int, list[int]] = {}
        self.blocks: dict[int, list[int]] = {}

    def sent(self, w: int) -> list[int]:
        """Ids that each queue sends in the first w windows."""
        if w >= self.end:
            return self.totals
        if w not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            lines = self.lines[bisect.bisect_right(self.starts, w) - 1]
            self.known[w] = [(a + b * w) // d for a, b, d in lines]
        return self.known[w]

    def block(self, w: int) -> list[int]:
        """Where the block of each queue begins in the stream, for window w."""
        if w not in self.blocks:
            if len(self.blocks) > 50_000:
                self.blocks.clear()
            a, b = self.sent(w), self.sent(w + 1)
            at, out = sum(a), []
            for x, y in zip(a, b, strict=True):
                out.append(at)
                at += y - x
            self.blocks[w] = out
        return self.blocks[w]

    def window_of(self, queue: int, x: int) -> int:
        """The window in which the x-th id of a queue is sent."""
        phase = bisect.bisect_right([base[queue] for base in self.base], x) - 1 if len(self.base) > 1 else 0
        a, b, d = self.lines[phase][queue]
        w = max(0, (x * d - a) // b) if b else 0
        while self.sent(w)[queue] > x:
            w -= 1
        while self.sent(w + 1)[queue] <= x:
            w += 1
        return w

    def pieces(self, queue: int, start: int, n: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(first id, number of ids, place in the stream) of the pieces of ids start ... start + n - 1 of a queue."""
        x, end = start, start + n
        while x < end:
            w = self.window_of(queue, x)
            place = self.block(w)[queue] + x - self.sent(w)[queue]
            m = min(end, self.sent(w + 1)[queue]) - x
            while m:
                k = min(m, length - place % length)
                yield x - start, k, place
                x, place, m = x + k, place + k, m - k


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Table part, doc_id, source, n, before (ids of its source before it in its partition), ids; parts in ascending doc_id."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        end = np.array([end_id], tool.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), {}
        for batch in together(batches, 2):
            sources = batch.column(1).to_pylist()
            ids = [b + end for b in tool.encode(batch.column(2).to_pylist())]
            n, before = [len(b) // tool.dtype.itemsize for b in ids], []
            for s, k in zip(sources, n, strict=True):
                before.append(seen.get(s, 0))
                seen[s] = before[-1] + k
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(n), pa.int32()), "doc_id": batch.column(0).combine_chunks(), "source": batch.column(1).combine_chunks(), "n": pa.array(n, pa.int64()), "before": pa.array(before, pa.int64()), "ids": pa.array(ids, pa.binary())})

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("n", T.LongType()), T.StructField("before", T.LongType()), T.StructField("ids", T.BinaryType())])
    return common.written(in_order(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")).select("doc_id", "source", "text").mapInArrow(run, schema), "packing-ids")


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, window: int = 8 * 2048, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of docs (doc_id, source, text): doc_id, source, start, length, ids, doc_tokens, sequence_id, offset."""
    table = tokenised(docs, path, end_id)
    sums = table.groupBy("source", "part").agg(F.sum("n").alias("n"))
    offsets = sums.select("source", "part", (F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("earlier"))
    offsets = common.written(offsets, "packing-offsets")
    totals = {r[0]: r[1] for r in sums.groupBy("source").agg(F.sum("n")).collect()}  # one number for each source
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    counts = [totals[s] for s in order]
    shares = [Fraction(str((weights or {}).get(s, 0))) or Fraction(totals[s]) for s in order] if weights else [Fraction(t) for t in counts]
    plan = Schedule(counts, shares, window)
    place = {s: i for i, s in enumerate(order)}
    small = offsets.count() <= BROADCAST_ROWS
    joined = table.join(F.broadcast(offsets) if small else offsets, table["part"].eqNullSafe(offsets["part"]) & table["source"].eqNullSafe(offsets["source"]))
    rows = joined.select("doc_id", table["source"], "n", (F.col("before") + F.col("earlier")).alias("first"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc, source, n, first, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arr = np.frombuffer(ids, dtype).astype("<u4")
                for a, k, at in plan.pieces(place[source], first, n, length):
                    for key, value in zip(out, (doc, source, a, k, arr[a : a + k].tobytes(), n, at // length, at % length), strict=True):
                        out[key].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], batch.schema.field(0).type), pa.array(out["source"], pa.string()), *(pa.array(out[k], pa.binary() if k == "ids" else pa.int64()) for k in list(out)[2:])], names=list(out))

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("source", T.StringType()), *(T.StructField(k, T.BinaryType() if k == "ids" else T.LongType()) for k in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset"))])
    return rows.mapInArrow(run, schema)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_ids and ids (binary, little-endian 32 bit), padded to ``length``, the last to a power of two."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(x["ids"] for x in sorted(row, key=lambda x: x["offset"])) for row in batch.column(1).to_pylist()]
            n = [len(b) // 4 for b in ids]
            pad = np.array([pad_id], "<u4").tobytes()
            full = [b + pad * (min(length, 1 << (k - 1).bit_length()) - k) for b, k in zip(ids, n, strict=True)]
            yield pa.RecordBatch.from_pydict({"sequence_id": batch.column(0), "n_ids": pa.array(n, pa.int64()), "ids": pa.array(full, pa.binary())})

    grouped = pieces.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("p"))  # at most ``length`` ids each
    return grouped.mapInArrow(join, "sequence_id long, n_ids long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op9_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.table(spark, sf_dir, "documents"), tokenizer_path()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document."""
    return digest(pack(docs, tokenizer_path()))
