"""Exact top-k by inner product, with candidates bucketed by length.

Vectors become integers, floor(scale * x).  Candidates are dealt by descending length (ties by id) and cut
into buckets of ``bucket`` rows of nearly one length.  For a query and a bucket the k-th score so far gives a local
cosine threshold, theta / (length of the query * greatest length in the bucket).  Above 1 the bucket is
left out; from ``coordinate_from`` on, the candidates are those whose coordinates lie in the feasible
intervals of the query's largest coordinates; below, the head of the bucket that is long enough (queries that
need a similar length share their products).  The products of what is left are verified in exact integers.

A first threshold comes from the longest ``seeds`` candidates (they only prune, every row is still searched).
Queries go in blocks of ``block`` rows, one after the other: a block is sent to all partitions, its k best are
written, and it is dropped before the next is read, so what the driver holds and sends does not grow.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no
part; shorter vectors are padded with zeros (an empty vector is zero); rows with the query's id are not its
candidates; queries of the same id are one query; components beyond the range in which products of longs
are exact raise an error; with fewer than k candidates all come back; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a column of arrays of numbers, and their vectors (padded with zeros) as doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = lists.to_pylist() if lists.null_count or lists.flatten().null_count else None
    if rows is None:
        offsets = np.asarray(lists.offsets)
        flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
        n = np.diff(offsets)
        if len(n) and n.min() == n.max():
            m = flat[offsets[0] : offsets[-1]].reshape(len(n), int(n[0]))
            good = np.isfinite(m).all(axis=1)
            return np.flatnonzero(good), m[good]
        rows = lists.to_pylist()
    keep = [i for i, r in enumerate(rows) if r is not None and all(x is not None and np.isfinite(x) for x in r)]
    wide = max((len(rows[i]) for i in keep), default=0)
    out = np.zeros((len(keep), wide))
    for j, i in enumerate(keep):
        out[j, : len(rows[i])] = rows[i]
    return np.array(keep, dtype=np.int64), out


def integer_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, norm (squared length), v (little-endian 64-bit integers) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = matrix(batch.column(1))
            m = np.floor(m * scale)
            if m.size and np.abs(m).max() >= 2.0**31:
                raise ValueError("a component is too large for exact integer scores")
            norm = (m * m).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0).take(pa.array(rows)).cast(pa.int64()), "norm": pa.array(norm), "v": pa.array([r.tobytes() for r in m.astype("<i8")], pa.binary())})

    return vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, "vec_id long, norm double, v binary")


def stack(rows: list[bytes], wide: int = 0) -> np.ndarray:
    wide = max([wide, *(len(b) // 8 for b in rows)])
    out = np.zeros((len(rows), wide), dtype=np.int64)
    for i, b in enumerate(rows):
        out[i, : len(b) // 8] = np.frombuffer(b, "<i8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top >= 2**63:
        raise ValueError("inner products do not fit 64-bit integers")
    return a @ b.T


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q = self.id = self.score = np.zeros(0, np.int64)
        self.theta = np.full(n, -(2.0**62))

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]
        last = rank == self.k - 1
        self.theta[q[last]] = np.maximum(self.theta[q[last]], score[last])


def feasible(q: np.ndarray, t: float, unit: np.ndarray, focus: int) -> np.ndarray:
    """Rows of the unit vectors whose largest-query coordinates lie where a cosine of t or more is possible."""
    ok = np.ones(len(unit), dtype=bool)
    rest = np.sqrt(max(0.0, 1 - t * t))
    for f in np.argsort(-np.abs(q), kind="stable")[:focus]:
        side = np.sqrt(max(0.0, 1 - q[f] * q[f])) * rest
        low = -1.0 if q[f] < -t else q[f] * t - side
        high = 1.0 if q[f] > t else q[f] * t + side
        ok &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
    return ok


#: Scores that wait to be sorted in among the best.
PENDING = 1 << 20


def search(best: Best, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, cand: np.ndarray, coordinate_from: float, focus: int = 3) -> None:
    """Search one bucket of candidates of nearly one length.

    Before thresholds are known most scores pass, so a chunk brings no more than its own best and their ties, and what
    has been found is sorted in whenever ``PENDING`` scores wait.
    """
    lengths = np.sqrt((cand.astype(np.float64) ** 2).sum(axis=1))
    longest = max(lengths.max(initial=0.0), 1e-12)
    qlen = np.maximum(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)), 1e-12)
    local = best.theta / (qlen * longest)
    live = np.flatnonzero(local <= 1 + 1e-9)  # the others cannot reach their k-th score in this bucket
    by_coordinate = live[local[live] >= coordinate_from]
    by_length = live[local[live] < coordinate_from]
    found, waiting = [], 0

    def keep(q: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        nonlocal waiting
        found.append((q, c, s))
        waiting += len(s)
        if waiting >= PENDING:
            flush()

    def flush() -> None:
        nonlocal waiting
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        found.clear()
        waiting = 0

    if len(by_coordinate):
        unit = cand / np.maximum(lengths, 1e-12)[:, None]
        for i in by_coordinate:
            c = np.flatnonzero(feasible(queries[i] / qlen[i], float(local[i]), unit, focus))
            if len(c):
                s = products(queries[i : i + 1], cand[c])[0]
                hit = (s >= best.theta[i]) & (ids[c] != query_ids[i])
                keep(np.full(hit.sum(), i), ids[c][hit], s[hit])
    if len(by_length):
        longer = np.argsort(-lengths, kind="stable")
        head, head_ids, falling = cand[longer], ids[longer], -lengths[longer]
        # the candidates long enough for a query: the first few of the bucket
        enough = np.searchsorted(falling, -(best.theta[by_length] / qlen[by_length]) * (1 - 1e-12), side="right")
        order = np.argsort(enough, kind="stable")
        for at in range(0, len(order), 512):
            rows, m = by_length[order[at : at + 512]], int(enough[order[at : at + 512]].max())
            if not m:
                continue
            s = products(queries[rows], head[:m])
            other = head_ids[None, :m] != query_ids[rows][:, None]
            hit = (s >= best.theta[rows][:, None]) & other
            if m > best.k and hit.sum() > 4 * best.k * len(rows):
                least = np.partition(np.where(other, s, np.iinfo(np.int64).min), m - best.k, axis=1)[:, m - best.k]
                hit &= s >= least[:, None]
            r, c = np.nonzero(hit)
            keep(rows[r], head_ids[c], s[r, c])
    flush()


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, block: int = 16384, bucket: int = 1024, seeds: int = 2048, coordinate_from: float = 0.85) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` the k best other rows."""
    spark = common.prepare(vectors.sparkSession)
    rows = integer_rows(vectors, scale)
    cand = common.written(rows.repartitionByRange(F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), "vec_id"), "topk-candidates")
    queries = queries_table = common.written(cand.filter(F.col("vec_id") % every == 0).select("vec_id", "v").dropDuplicates(), "topk-queries")
    n = queries.count()
    blocks = max(1, -(-n // block))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    first = [(r.vec_id, r.v) for r in cand.orderBy(F.col("norm").desc(), "vec_id").limit(seeds).collect()]
    found = []
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for b in range(blocks):
        own = sorted((r.vec_id, r.v) for r in queries.filter(F.col("block") == b).select("vec_id", "v").collect())
        qid, q = np.array([x for x, _ in own], np.int64), stack([v for _, v in own])
        start = Best(len(own), k)
        if own and first:
            both = stack([v for _, v in first], q.shape[1])
            q = np.pad(q, ((0, 0), (0, both.shape[1] - q.shape[1])))
            search(start, q, qid, np.array([x for x, _ in first], np.int64), both, 2.0)
        sent = spark.sparkContext.broadcast((qid, q.astype(np.int32), start.theta))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q, theta = sent.value
            q = q.astype(np.int64)
            best = Best(len(qid), k)
            best.theta = theta.copy()
            held_ids: list[np.ndarray] = []
            held: list[bytes] = []

            def flush() -> None:
                nonlocal q
                m = stack(held, q.shape[1])
                q = np.pad(q, ((0, 0), (0, m.shape[1] - q.shape[1])))
                search(best, q, qid, np.concatenate(held_ids), m, coordinate_from)
                held.clear()
                held_ids.clear()

            for batch in batches:
                held_ids.append(batch.column(0).to_numpy())
                held.extend(batch.column(1).to_pylist())
                if len(held) >= bucket:
                    flush()
            if held:
                flush()
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid[best.q]), "vec_id": pa.array(best.id), "score": pa.array(best.score)})

        part = cand.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(common.written(part, "topk-best"))
        sent.destroy()
    common.discard(cand, queries_table)
    return functools.reduce(DataFrame.unionAll, found)


def op5_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
