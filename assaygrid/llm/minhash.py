"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct shingles of ``size`` words (A-Z lower-cased).  Sets are searched in
independent random trees.  At a node, ``BRANCH`` coordinates of the minwise sketch are drawn from the node's
own hash; a set follows each of them to the child named by its token there, so similar sets keep choosing
the same paths.  A pair of similarity s meets in a child with probability 1 - (1 - s)**2, and survives any
number of levels with the fixed probability p = 1 - ((1 - s) / s)**2 (0.94 at 0.8): ``trees`` are as many as
the target recall asks, 1 - (1 - p)**trees.  Nodes of up to ``leaf`` sets are compared exhaustively, by
sketch; larger ones branch on, unless few different tokens stand in them: such a node holds near copies, which no
path splits.

Comparing has two rounds.  First one partner of each set in its node is confirmed on the full sets and the
links are joined to components.  Here a node larger than ``leaf``, one of near copies or one still large at the
last level, is compared in overlapping blocks of sets that stand together in an order of sketches of the node's
own, each block together with its first set; a node of more than ``DEAL`` leaves is dealt over tasks by hash.
Then sets with candidates in other components of their node come to it with their texts, and all those
candidates are tried there on the full sets, as long as their components differ.  In a node larger than
``leaf`` each set outside the node's largest component is compared with every set of the node, in cells of about
``leaf`` rows; two sets of the largest component are joined already.  So no link between sets of a node is lost,
and the work is the number of sets outside the largest component times the number of sets.
Only confirmed links leave a node: a group of thousands of near copies never becomes rows for all its pairs.

A set's key is that of its text; equal texts are one row until the end.

Defined cases: null texts and texts without a word have the empty set, link with nothing and are their own
component; a text with fewer than ``size`` words has its whole word sequence as its one shingle; equal ids
are rows of their own, a component's id is the smallest of its rows' ids; a null id gets its component's id,
or null if all are null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import hashed, mixed, runs

SKETCH = 128
BRANCH = 2
LEVELS = 4
#: A first-round task holds about so many leaves of one node.
DEAL = 8
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def trees_for(similarity: float, recall: float) -> int:
    miss = ((1 - similarity) / similarity) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if 0 < miss < 1 else 1


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for block in hashed(texts, lower=True):
        grams = runs(block.hashes, size)
        for i, t in enumerate(block.texts):
            a, b = int(block.first[i]), int(block.first[i + 1])
            if b - a >= size:
                out[t] = np.unique(grams[a : b - size + 1])
            elif b > a:
                out[t] = runs(block.hashes[a:b], b - a)
    return out


def sketch(s: np.ndarray) -> bytes:
    """Minwise values under SKETCH hash functions, 32 bits each."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        least = np.minimum(least, (s[None, i : i + 2048] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return (mixed(least) >> np.uint64(32)).astype("<u4").tobytes()


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key (null for a null text), n (set size), s (sketch; null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x) if len(x) else None for x in sets], pa.binary())], names=["doc_id", "key", "n", "s"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("key"), "text").mapInArrow(run, "doc_id long, key binary, n long, s binary")


def _token(s: Column, at: Column) -> Column:
    return F.substring(s, at * 4 + 1, F.lit(4))


def _branches(node: Column) -> Column:
    """The coordinates that a node chooses."""
    one = F.pmod(F.xxhash64(node, F.lit("first")), F.lit(SKETCH)).cast("int")
    two = (one + 1 + F.pmod(F.xxhash64(node, F.lit("second")), F.lit(SKETCH - 1)).cast("int")) % SKETCH
    return F.array(one, two)


def leaves(sets: DataFrame, trees: int, leaf: int, levels: int) -> DataFrame:
    """node, key, n, s, members: the members of every node that is not branched further; single members are left out."""
    roots = sets.select("key", "n", "s", F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(trees)])).alias("node"))
    done = None
    for level in range(levels):
        at = roots.withColumn("c", F.explode(_branches(F.col("node"))))
        child = F.xxhash64("node", "c", F.expr("substring(s, c * 4 + 1, 4)"))
        placed = at.select("key", "n", "s", child.alias("node"))
        if level == 0:
            placed = common.written(placed.select("node", "key"), "paths")
        else:
            placed = common.written(placed, "paths")
        # written, so that the join is of two plain exchanges, which can be split at a hot node
        counts = common.written(placed.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1"), "counts")
        more = placed.join(counts, "node")
        if level == 0:
            more = more.join(sets, "key").select("node", "key", "n", "s", "members")
        more = common.written(more, "nodes")
        common.discard(placed, counts)
        large = more.filter(F.col("members") > leaf)
        loose = []
        if level < levels - 1:  # a node in which few tokens stand at the coordinates holds near copies: no path splits it
            kinds = large.groupBy("node").agg(F.max("members").alias("m"), *[F.approx_count_distinct(F.substring("s", 4 * c + 1, 4)).alias(f"k{c}") for c in range(4)])
            loose = kinds.filter((F.col("k0") + F.col("k1") + F.col("k2") + F.col("k3")) / 4 >= 0.5 * F.col("m")).select("node")
            loose = common.written(loose, "loose")
        if not loose or not loose.take(1):
            final = more
        else:
            final = more.join(loose, "node", "left_anti")
        done = final if done is None else done.unionByName(final)
        if final is more:
            break
        roots = large.join(loose, "node", "left_semi").drop("members")
    return done


def similar(n: np.ndarray, sk: np.ndarray, least: float, slack: float, asking: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """For runs of rows a ... b - 1 of a node: how many sketch values each shares with every row, -1 where a pair is no candidate.

    With ``asking``, only the first so many rows are compared with all rows.
    """
    size = len(n)
    asking = size if asking is None else asking
    columns = [np.ascontiguousarray(sk[:, j]) for j in range(SKETCH)]
    for a in range(0, asking, 256):
        b = min(asking, a + 256)
        same = np.zeros((b - a, size), dtype=np.int16)
        for col in columns:
            same += col[a:b, None] == col[None, :]
        est = np.where((same >= SKETCH * (least - slack)) & (np.minimum(n[a:b, None], n[None, :]) >= least * np.maximum(n[a:b, None], n[None, :]) - 1e-9), same, -1)
        est[np.arange(b - a), np.arange(a, b)] = -1
        yield a, b, est


def partners(keys: list[bytes], n: np.ndarray, sk: np.ndarray, least: float, slack: float) -> set[tuple[bytes, bytes]]:
    """Each set's first partner in its node, or its best where the first is not surely similar."""
    out = set()
    for a, b, est in similar(n, sk, least, slack):
        best, first = est.argmax(axis=1), (est >= 0).argmax(axis=1)
        sure = est[np.arange(b - a), first] >= SKETCH * min(1.0, least + slack / 2)
        ok = np.flatnonzero(est.max(axis=1) >= 0)
        out |= {(keys[min(i, j)], keys[max(i, j)]) for i, j in zip((ok + a).tolist(), np.where(sure, first, best)[ok].tolist(), strict=True)}
    return out


def across(n: np.ndarray, sk: np.ndarray, part: np.ndarray, asking: int, least: float, slack: float) -> np.ndarray:
    """Whether each set is in a candidate pair of an asking set and a set of another component."""
    out = np.zeros(len(n), dtype=bool)
    for a, b, est in similar(n, sk, least, slack, asking):
        pair = (est >= 0) & (part[a:b, None] != part[None, :])
        out[a:b] |= pair.any(axis=1)
        out |= pair.any(axis=0)
    return out


def confirm_node(sets: list[np.ndarray], n: np.ndarray, sk: np.ndarray, part: np.ndarray, asking: int, least: float, slack: float, percent: int) -> list[tuple[int, int]]:
    """Links of the first ``asking`` sets to other components, all candidates tried on the full sets; no more links than join them."""
    lens = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(lens) - lens
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    part, links = part.copy(), []
    for a, b, est in similar(n, sk, least, slack, asking):
        for i in range(a, b):
            j = np.flatnonzero((est[i - a] >= 0) & (part != part[i]))
            j = j[j > i]
            if not len(j):
                continue
            mark[flat[at[i] : at[i] + lens[i]]] = 1
            for c in range(0, len(j), 256):
                some = j[c : c + 256]
                ids = np.concatenate([flat[at[x] : at[x] + lens[x]] for x in some.tolist()])
                shared = np.add.reduceat(mark[ids], np.cumsum(lens[some]) - lens[some])
                for x in some[100 * shared >= percent * (lens[i] + lens[some] - shared)].tolist():
                    if part[x] != part[i]:
                        links.append((i, x))
                        part[part == part[x]] = part[i]
            mark[flat[at[i] : at[i] + lens[i]]] = 0
    return links


def node_runs(batches: Iterator[pa.RecordBatch], keys: int, leaf: int | None, at: int) -> Iterator[list[tuple]]:
    """Rows of one node after the other (the first ``keys`` columns name it), in order of column ``at``.

    With ``leaf``, a node of more rows comes in overlapping blocks, each with the node's first row.
    """
    node, leader, rows = None, None, []

    def ordered() -> list[tuple]:
        # a hash's order, alike in all nodes, so that a group's first member is mostly the same one
        return sorted(rows, key=lambda r: r[at])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != node:
                if len(rows) > 1:
                    yield ordered()
                node, leader, rows = row[:keys], row, []
            elif leaf and len(rows) >= leaf:
                yield ordered()
                rows = [leader, *rows[-(leaf // 4) :]]
            rows.append(row)
    if len(rows) > 1:
        yield ordered()


def _sketches(rows: list[tuple], at: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), "<u4").reshape(-1, SKETCH)


def candidates(nodes: DataFrame, leaf: int, least: float, slack: float) -> DataFrame:
    """First-round pairs (u, v) of keys from nodes (node, key, n, s, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in node_runs(batches, 2, leaf, 2):
            pairs = sorted(partners([r[2] for r in rows], np.array([r[3] for r in rows]), _sketches(rows, 4), least, slack))
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in pairs], pa.binary()), "v": pa.array([v for _, v in pairs], pa.binary())})

    deal = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("members") / (DEAL * leaf))).alias("deal")
    turned = F.expr(f"substring(s, 4 * pmod(node, {SKETCH}) + 1)")  # a node's order begins at a coordinate of its own
    rows = nodes.select("node", deal, "key", "n", "s").repartition("node", "deal").sortWithinPartitions("node", "deal", turned, "key")
    return rows.mapInArrow(run, "u binary, v binary").distinct()


def _numbers(values: list) -> np.ndarray:
    names = {p: k for k, p in enumerate(dict.fromkeys(values))}
    return np.array([names[v] for v in values])


def cells(labelled: DataFrame, sets: DataFrame, leaf: int) -> DataFrame:
    """node, cell, asks, key, n, s, part from labelled (node, key, part): rows to compare, for nodes of several components.

    A node of up to ``leaf`` sets is one cell, in which every row asks.  In a larger one the sets outside its
    largest component ask: cell (i, j) holds block i of the asking rows and block j of all rows.
    """
    per = labelled.groupBy("node", "part").agg(F.count("*").alias("c"))
    sizes = per.groupBy("node").agg(F.sum("c").alias("m"), F.max(F.struct("c", "part")).alias("top")).filter("top.c < m")
    half = max(1, leaf // 2)
    large = F.col("m") > leaf
    sizes = sizes.select("node", F.col("top.part").alias("main"), large.alias("large"), F.ceil((F.col("m") - F.col("top.c")) / half).cast("int").alias("across"), F.ceil(F.col("m") / half).cast("int").alias("down"))
    sizes = common.written(sizes, "sizes")
    rows = labelled.join(sizes, "node").join(sets.select("key", "n", "s"), "key")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("key", "node"), F.col("across")).cast("int")).withColumn("j", F.pmod(F.xxhash64("node", "key"), F.col("down")).cast("int")).withColumn("out", F.col("part") != F.col("main"))
    asked = F.expr("transform(filter(sequence(0, across - 1), x -> NOT out OR x <> i), x -> struct(x AS i, j AS j, false AS asks))")
    asking = F.expr("CASE WHEN out THEN transform(sequence(0, down - 1), x -> struct(i AS i, x AS j, true AS asks)) ELSE array() END")
    one = F.expr("array(struct(0 AS i, 0 AS j, true AS asks))")
    return rows.select("node", "key", "n", "s", "part", F.explode(F.when(F.col("large"), F.concat(asked, asking)).otherwise(one)).alias("at")).select("node", F.struct("at.i", "at.j").alias("cell"), "at.asks", "key", "n", "s", "part")


def _asking_first(rows: list[tuple]) -> tuple[list[tuple], int]:
    rows = sorted(rows, key=lambda r: not r[3])
    return rows, sum(r[3] for r in rows)


def unsettled(dealt: DataFrame, least: float, slack: float) -> DataFrame:
    """Rows of cells that are in a candidate pair of different components there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in node_runs(batches, 3, None, 4):
            rows, asking = _asking_first(rows)
            part = _numbers([r[7] for r in rows])
            if not asking or not part.any():
                continue
            keep = [r for r, ok in zip(rows, across(np.array([r[5] for r in rows]), _sketches(rows, 6), part, asking, least, slack), strict=True) if ok]
            columns = zip(*keep, strict=True) if keep else ([],) * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["node", "i", "j", "asks", "key", "n", "s", "part"])

    rows = dealt.select("node", "cell.i", "cell.j", "asks", "key", "n", "s", "part")
    rows = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    return rows.mapInArrow(run, "node long, i int, j int, asks boolean, key binary, n long, s binary, part binary")


def settled(members: DataFrame, texts: DataFrame, size: int, percent: int, slack: float) -> DataFrame:
    """Links (u, v) between components, from all candidates of the members' cells, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in node_runs(batches, 3, None, 4):
            rows, asking = _asking_first(rows)
            links = confirm_node(shingle_sets([r[8] for r in rows], size), np.array([r[5] for r in rows]), _sketches(rows, 6), _numbers([r[7] for r in rows]), asking, percent / 100, slack, percent)
            yield pa.RecordBatch.from_pydict({"u": pa.array([rows[i][4] for i, _ in links], pa.binary()), "v": pa.array([rows[j][4] for _, j in links], pa.binary())})

    rows = members.join(texts, "key").select("node", "i", "j", "asks", "key", "n", "s", "part", "text")
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(run, "u binary, v binary")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            u, v, tu, tv = (c.to_pylist() for c in batch.columns)
            other = shingle_sets(tv, size)
            fresh = [i for i in range(len(u)) if u[i] != (u[i - 1] if i else last)]
            own = dict(zip(fresh, shingle_sets([tu[i] for i in fresh], size), strict=True))
            keep = []
            for i in range(len(u)):
                held = own.get(i, held)
                common_n = len(np.intersect1d(held, other[i], assume_unique=True))
                keep.append(common_n > 0 and 100 * common_n >= percent * (len(held) + len(other[i]) - common_n))
            last = u[-1] if u else last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("key").alias("v"), F.col("text").alias("tv")), "v")
    two = one.join(texts.select(F.col("key").alias("u"), F.col("text").alias("tu")), "u")
    return two.select("u", "v", "tu", "tv").mapInArrow(run, "u binary, v binary")


def needed_texts(docs: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """key and text of the sets in keys, one row each (equal rows of the input are one)."""
    wanted = keys.distinct().join(sets.select("key", "id"), "key")
    rows = docs.filter(F.col("text").isNotNull()).select(common.text_key().alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return common.written(rows.join(wanted, ["key", "id"]).select("key", "text").dropDuplicates(["key"]), "texts")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, recall: float = 0.9997, leaf: int = 2048, levels: int = LEVELS, slack: float = 0.15) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and key (of the text) of every row of docs (doc_id, text)."""
    common.prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    least = percent / 100
    rows = common.written(sketched(docs, size), "sketches")
    sets = rows.filter("n > 0").groupBy("key", "n", "s").agg(F.min("doc_id").alias("rep"), F.min(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("id"))
    sets = common.written(sets, "sets")
    nodes = common.written(leaves(sets.select("key", "n", "s"), trees_for(least, recall), leaf, levels), "leaves")
    pairs = common.written(candidates(nodes, leaf, least, slack), "pairs")
    texts = needed_texts(docs, sets, pairs.select(F.explode(F.array("u", "v")).alias("key")))
    links = common.written(confirmed(pairs, texts, size, percent), "links")
    common.discard(texts, pairs)
    part_of = common.written(components(links), "parts")
    labelled = nodes.select("node", "key").join(part_of.withColumnRenamed("node", "key"), "key", "left").select("node", "key", F.coalesce("component", "key").alias("part"))
    labelled = common.written(labelled, "labelled")
    common.discard(nodes)
    members = common.written(unsettled(cells(labelled, sets, leaf), least, slack), "unsettled")
    common.discard(labelled)
    if members.take(1):
        texts = needed_texts(docs, sets, members.select("key"))
        more = common.written(settled(members, texts, size, percent, slack), "links")
        common.discard(texts, members)
        if more.take(1):
            part_of = common.written(components(links.unionAll(more)), "parts")
    of = sets.join(part_of.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("part"))
    ids = of.groupBy("part").agg(F.min("rep").alias("component_id"))
    labels = of.join(ids, "part").select("key", "component_id")
    out = rows.select("doc_id", "key", "n").join(labels, "key", "left")
    part = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), part.alias("component_id"), F.coalesce(part == F.col("doc_id"), part.isNull()).alias("kept"), "key")


def op8_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates (five-word shingles, similarity 0.8) stays.

    Rows that repeat a kept id are near copies of each other only if they are in one group; of those one stays.
    """
    found = near_duplicates(docs)
    gone = common.written(found.filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__gone")).distinct(), "gone")
    several = found.filter("kept AND n_shingles > 0").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("key")).alias("k")).count().filter("count > 1")
    several = common.written(several.select(F.col("doc_id").alias("__id"), F.col("k").alias("__k")), "several")
    keyed = docs.withColumn("__key", common.text_key())
    kept = keyed.join(gone, (F.col("__key") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    if not several.take(1):
        return kept.select(*docs.columns)
    # rows that repeat a kept id in one group (without ids: a kept text)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k").isNull() | (F.col("__k") == F.col("__key"))) & F.col("__key").isNotNull()
    order = Window.partitionBy("doc_id", "__k").orderBy("__row")  # the first of them as JSON, so that reruns agree
    again = kept.join(several, same, "left_semi").withColumns({"__k": F.when(F.col("doc_id").isNull(), F.col("__key")), "__row": F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))})
    again = again.withColumn("__place", F.row_number().over(order)).filter("__place = 1")
    return kept.join(several, same, "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
