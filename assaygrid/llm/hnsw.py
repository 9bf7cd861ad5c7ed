"""Near-duplicate embeddings by navigable small-world graphs, one for each shard.

Equal vectors are grouped first; the distinct ones are dealt by hash into shards of bounded size.  Each shard
gets a hierarchical navigable small-world graph (layers of geometrically fewer nodes, neighbours chosen
for diversity).  Every distinct vector queries every shard: from the top layer down, then by a beam in the
bottom layer.  A beam whose worst member still reaches the threshold is widened until it does not; and a
block of queries audits a sample of itself against all of the shard's vectors, doubling its beams until the
recall of links to other vectors reaches ``recall``, both over the whole sample and as the mean over its queries,
so that one dense group cannot hide the losses of small ones (a beam as wide as the shard is an exhaustive
search).  Links are verified by cosine in double precision and joined to components.

Builds and searches run in lockstep over many vectors, in numpy.  A (block, shard) task returns, for each
query, how many vectors it is linked with, and edges that connect the linked vectors (a spanning star of each
local component), so a dense group returns no pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components, link with nothing and
are their own component; vectors of different lengths are padded with zeros; equal rows link with each
other; rows without an id come back with no links and a null component; an empty table gives an empty
result; label and other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

FAN = 16  # one node in FAN reaches the next layer
TOP = 64  # the top layer is searched exhaustively
DEGREE = 16  # neighbours chosen at insertion; a node keeps up to four times as many


def diverse(base: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates (descending similarity, -1: none), those nearer to the row's vector than to one already chosen."""
    n, c = cand.shape
    x = base[np.maximum(cand, 0)]
    cross = np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros((n, c), dtype=bool)
    count = np.zeros(n, dtype=int)
    for j in range(c):
        near = np.where(chosen, cross[:, j, :], -2).max(axis=1)
        ok = (cand[:, j] >= 0) & (count < most) & (sims[:, j] > near)
        chosen[:, j] = ok
        count += ok
    for j in range(c):  # fill up with the nearest
        ok = (cand[:, j] >= 0) & (count < most) & ~chosen[:, j]
        chosen[:, j] |= ok
        count += ok
    return chosen


class Layer:
    def __init__(self, n: int):
        self.near = np.full((n, 4 * DEGREE), -1, dtype=np.int32)
        self.degree = np.zeros(n, dtype=np.int32)

    def beam(self, base: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, at_once: int = 2, stop: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities (descending, -1 and -2: none) of the ``width`` nearest nodes found for each query."""
        b, n = len(q), len(base)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), dtype=bool)
        ids = np.full((b, width), -1, dtype=np.int64)
        sims = np.full((b, width), -2.0, dtype=np.float32)
        entry = entry[:, :width]
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("bed,bd->be", base[np.maximum(entry, 0)], q), -2)
        seen[rows, entry] = True
        done = ids < 0
        live = np.arange(b)
        while len(live):
            s = np.where(done[live], -3.0, sims[live])
            pick = np.argpartition(-s, min(at_once, width) - 1, axis=1)[:, :at_once]
            some = np.take_along_axis(s, pick, 1) > -2.5
            go = some.any(axis=1)
            live, pick, some = live[go], pick[go], some[go]
            if not len(live):
                break
            lrows = live[:, None]
            nodes = np.where(some, ids[lrows, pick], -1)
            done[lrows, pick] = True
            near = np.where((nodes >= 0)[:, :, None], self.near[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            if at_once > 1:  # a node reached twice at once counts once
                order = np.argsort(near, axis=1)
                near = np.take_along_axis(near, order, 1)
                near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(seen[lrows, near], -1, near)
            full = ~(near < 0).all(axis=0)
            near = near[:, full]
            if not near.shape[1]:
                continue
            seen[lrows, near] = True
            seen[lrows, -1] = False
            new = np.where(near >= 0, np.einsum("bed,bd->be", base[np.maximum(near, 0)], q[live]), -2).astype(np.float32)
            ai, asim = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], new], axis=1)
            ad = np.concatenate([done[live], near < 0], axis=1)
            top = np.argpartition(-asim, width - 1, axis=1)[:, :width]
            ids[live], sims[live], done[live] = np.take_along_axis(ai, top, 1), np.take_along_axis(asim, top, 1), np.take_along_axis(ad, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def link(self, base: np.ndarray, new: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        chosen = diverse(base, cand, sims, DEGREE)
        for i, node in enumerate(new):
            own = cand[i][chosen[i]]
            self.near[node, : len(own)] = own
            self.degree[node] = len(own)
        src, dst = np.repeat(new, chosen.sum(axis=1)), cand[chosen]
        full: set[int] = set()
        waiting = list(zip(dst.tolist(), src.tolist(), strict=True))
        while waiting:
            later = []
            for a, b in waiting:
                k = self.degree[a]
                if k == self.near.shape[1]:
                    full.add(a)
                    later.append((a, b))
                elif b not in self.near[a, :k]:
                    self.near[a, k] = b
                    self.degree[a] = k + 1
            if full:
                self.thin(base, np.array(sorted(full)))
                full.clear()
            waiting = later

    def thin(self, base: np.ndarray, nodes: np.ndarray) -> None:
        """Halve the neighbours of full nodes."""
        near = self.near[nodes]
        sims = np.einsum("bed,bd->be", base[near], base[nodes])
        order = np.argsort(-sims, axis=1, kind="stable")
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        chosen = diverse(base, near, sims, 2 * DEGREE)
        for i, node in enumerate(nodes):
            own = near[i][chosen[i]]
            self.near[node] = -1
            self.near[node, : len(own)] = own
            self.degree[node] = len(own)


class Graph:
    """Layers over unit vectors in random order: layer 0 has all, layer i the first 1/FAN**i of them."""

    def __init__(self, base: np.ndarray, width: int = 40):
        self.base = base.astype(np.float32)
        self.sizes = [len(base)]
        while self.sizes[-1] > TOP:
            self.sizes.append(max(1, self.sizes[-1] // FAN))
        self.layers = [Layer(n) for n in self.sizes[:-1]]
        for level in range(len(self.layers) - 1, -1, -1):
            self.build(level, width)

    def build(self, level: int, width: int) -> None:
        layer, n = self.layers[level], self.sizes[level]
        at = 0
        while at < n:
            size = min(n - at, 512, max(32, at))
            new = np.arange(at, at + size)
            q = self.base[new]
            within = q @ q.T
            within[np.arange(size), np.arange(size)] = -2
            k = min(DEGREE, size - 1)
            mates = np.argpartition(-within, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((size, 0), int)
            ids, sims = mates + at, np.take_along_axis(within, mates, 1)
            if at:
                entry = self.entry(q, level)
                entry = np.where(entry < at, entry, 0)
                found, fs = layer.beam(self.base[:at], q, entry, min(width, at))
                ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([fs, sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            layer.link(self.base, new, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1))
            at += size

    def entry(self, q: np.ndarray, level: int) -> np.ndarray:
        """Nodes at which a search of a layer starts, found in the layers above."""
        top = q @ self.base[: self.sizes[-1]].T
        k = min(4, top.shape[1])
        at = np.argpartition(-top, k - 1, axis=1)[:, :k]
        for up in range(len(self.layers) - 1, level, -1):
            at = self.layers[up].beam(self.base[: self.sizes[up]], q, at, 8)[0][:, :4]
        return at

    def near(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.layers or width >= len(self.base):
            sims = q @ self.base.T
            order = np.argsort(-sims, axis=1, kind="stable")
            return order, np.take_along_axis(sims, order, 1)
        return self.layers[0].beam(self.base, q, self.entry(q, 0), width)


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a length, as unit vectors."""
    top = np.abs(m).max(axis=1, initial=0)
    good = np.flatnonzero(top > 0)
    m = m[good] / top[good][:, None]
    return good, m / np.sqrt((m * m).sum(axis=1))[:, None]


def linked(graph: Graph, exact: np.ndarray, q: np.ndarray, least: float, width: int, recall: float, ids: np.ndarray, qids: np.ndarray, audit: int = 128, slack: float = 1e-4) -> list[np.ndarray]:
    """For each query the other nodes with cosine >= least, by beams that widen until audits pass."""
    n = len(exact)
    q32 = q.astype(np.float32)
    step = max(1, len(q) // audit)
    sample = np.arange(0, len(q), step)
    truth = ((q[sample] @ exact.T >= least) & (ids[None, :] != qids[sample][:, None])).sum(axis=1)
    some = truth > 0
    while True:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        rows, w = np.arange(len(q)), min(width, n)
        while len(rows):
            wider = []
            for a in range(0, len(rows), max(1, min(1024, (1 << 26) // max(1, n)))):
                part = rows[a : a + max(1, min(1024, (1 << 26) // max(1, n)))]
                at, sims = graph.near(q32[part], w)
                hit = (at >= 0) & (sims >= least - slack)
                more = hit.all(axis=1) & (w < n)
                for i, r in enumerate(part):
                    if more[i]:
                        wider.append(r)
                    elif hit[i].any():
                        c = at[i][hit[i]]
                        out[r] = c[(exact[c] @ q[r] >= least) & (ids[c] != qids[r])]
            rows, w = np.array(wider, dtype=np.int64), min(4 * w, n)
        got = np.array([len(out[s]) for s in sample])
        if width >= n or (got.sum() >= recall * truth.sum() and (got[some] / truth[some]).sum() >= recall * some.sum()):
            return out
        width *= 2


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while parent.setdefault(root, root) != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def near_duplicates(vectors: DataFrame, least: float = 0.95, shard_rows: int = 32768, min_shards: int = 8, block_rows: int = 32768, width: int = 24, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = common.prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    groups = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"))

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .topk import matrix

        for batch in batches:
            at, m = matrix(batch.column(0))
            good, u = unit(m)
            at = pa.array(at[good])
            yield pa.RecordBatch.from_pydict({"rep": batch.column(2).take(at), "m": batch.column(1).take(at), "embedding": batch.column(0).take(at), "v": pa.array([x.tobytes() for x in u], pa.binary())})

    kind = rows.schema["embedding"].dataType.simpleString()
    distinct = common.written(groups.mapInArrow(usable, f"rep long, m long, embedding {kind}, v binary"), "hnsw-vectors")
    n = distinct.count()
    shards, blocks = max(min_shards, math.ceil(n / shard_rows)), max(min_shards, math.ceil(n / block_rows))
    dealt = distinct.select("rep", "m", "v", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(blocks)).cast("int").alias("block"))

    def packed(pdf):
        pdf = pdf.sort_values("rep")
        wide = max(map(len, pdf.v)) // 8
        m = np.zeros((len(pdf), wide))
        for i, b in enumerate(pdf.v):
            m[i, : len(b) // 8] = np.frombuffer(b)
        return pdf.rep.to_numpy(np.int64), pdf.m.to_numpy(np.int64), m

    def build(pdf):
        import pandas as pd

        ids, count, m = packed(pdf)
        order = np.random.default_rng(len(ids)).permutation(len(ids))
        ids, count, m = ids[order], count[order], m[order]
        return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "index": [pickle.dumps((ids, count, m, Graph(m)), 5)]})

    def gather(pdf):
        import pandas as pd

        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "queries": [pickle.dumps(packed(pdf), 5)]})

    # a shard and a block have at most about shard_rows and block_rows rows, whatever the input
    index = common.written(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(build, "shard int, index binary"), "hnsw-index", "none")
    queries = common.written(dealt.repartition(blocks, "block").groupBy("block").applyInPandas(gather, "block int, queries binary"), "hnsw-queries", "none")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, asked in zip(batch.column(0), batch.column(1), strict=True):
                ids, count, exact, graph = pickle.loads(raw.as_py())
                qids, _, q = pickle.loads(asked.as_py())
                wide = max(q.shape[1], exact.shape[1])
                q, exact = np.pad(q, ((0, 0), (0, wide - q.shape[1]))), np.pad(exact, ((0, 0), (0, wide - exact.shape[1])))
                graph.base = np.pad(graph.base, ((0, 0), (0, wide - graph.base.shape[1])))
                node, links, parent = [], [], {}
                for x, c in zip(qids.tolist(), linked(graph, exact, q, least, width, recall, ids, qids), strict=True):
                    if len(c):
                        node.append(x)
                        links.append(int(count[c].sum()))
                        for y in ids[c].tolist():
                            a, b = _find(parent, x), _find(parent, y)
                            if a != b:
                                parent[max(a, b)] = min(a, b)
                edges = [(x, r) for x in parent if (r := _find(parent, x)) != x]
                yield pa.RecordBatch.from_pydict({"node": pa.array([*node, *(x for x, _ in edges)], pa.int64()), "links": pa.array([*links, *([None] * len(edges))], pa.int64()), "root": pa.array([*([None] * len(node)), *(r for _, r in edges)], pa.int64())})

    pairs = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, "shard").select("index", "queries")
    with common.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):  # an index and a block of queries at a time
        found = common.written(pairs.mapInArrow(ask, "node long, links long, root long"), "hnsw-links")
    part_of = components(found.filter("root IS NOT NULL").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    of = distinct.join(links, distinct.rep == links.node, "left").join(part_of.select(F.col("node").alias("p"), "component"), F.col("rep") == F.col("p"), "left")
    of = of.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.alias("r").join(of.alias("o"), (F.col("r.embedding") == F.col("o.embedding")) & F.col("r.vec_id").isNotNull(), "left")
    return out.select("r.vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "r.vec_id").alias("component_id"), (F.coalesce("c", "r.vec_id") == F.col("r.vec_id")).alias("kept"))


def op6_graph_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
