"""Registration of motif pairs: best offset and orientation on unsigned cores, signed similarity there, a null of shuffles.

A motif is an array of rows of four numbers (A, C, G, T), laid out flat.  Its core runs from the first to the last row
whose largest absolute value reaches ``TRIM`` of the motif's largest; its PPM is abs(v) / row sum.  Offsets count from
the starts of the cores.  Motifs are dealt into blocks by range of id; a task reads a few blocks of either side and holds
two at a time, and the work grows with the number of pairs, all of which are the result.

Defined cases: motifs that are null, empty, ragged (not four numbers a row) or hold null or non-finite numbers have no
PPM and register with nothing; lengths may differ; a motif without any contribution is all core and has similarity 0;
pairs without an overlap of ``least`` rows and ``share`` of each core have no row; no motifs give an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import one_thread, ship, written

# The core's share of the largest contribution, the overlap floors, and the names of the rule.
TRIM = 0.3
LEAST_ROWS, LEAST_SHARE = 6, 0.5
REGISTERED_ON, RULE = "unsigned_ppm", "unsigned_ppm_trimmed_core_v2"


@dataclass
class Cores:
    ppm: np.ndarray  # (n, L, 4), from row 0, zeros behind
    cwm: np.ndarray
    length: np.ndarray

    def turned(self, what: np.ndarray) -> np.ndarray:
        """Reverse complements of the cores, from row 0."""
        rows = np.arange(what.shape[1])
        at = np.clip(self.length[:, None] - 1 - rows, 0, None)
        return np.where((rows < self.length[:, None])[:, :, None], np.take_along_axis(what, at[:, :, None], 1)[:, :, ::-1], 0)

    def of(self, at, rows: int) -> Cores:
        """The cores at some places, as far as the longest of them, which has so many rows."""
        return Cores(self.ppm[at, :rows], self.cwm[at, :rows], self.length[at])

    def shuffled(self, seed: int, k: int) -> Cores:
        """Rows of each core in the k-th order of its length."""
        rows = np.tile(np.arange(self.ppm.shape[1]), (len(self.length), 1))
        for n in np.unique(self.length):
            rows[self.length == n, :n] = shuffle(seed, k, int(n))
        return Cores(np.take_along_axis(self.ppm, rows[:, :, None], 1), self.cwm, self.length)


@functools.cache
def shuffle(seed: int, k: int, n: int) -> np.ndarray:
    """An order of n rows that depends on the seed, the number of the shuffle and the length alone."""
    return np.array(sorted(range(n), key=lambda i: hashlib.md5(f"{seed}|{k}|{n}|{i}".encode()).digest()), dtype=np.int64)


def cores(motifs: list, trim: float = TRIM) -> Cores:
    """Cores of flat motifs of any lengths; ``trim`` 0 takes whole motifs."""
    size = max((len(x) // 4 for x in motifs), default=1)
    m, rows = np.zeros((len(motifs), size, 4)), np.array([len(x) // 4 for x in motifs])
    for i, x in enumerate(motifs):
        m[i, : rows[i]] = np.asarray(x, dtype=np.float64).reshape(-1, 4)
    m /= np.maximum(np.abs(m).max((1, 2), keepdims=True), 1e-300)  # cosines do not depend on the scale
    top = np.where(np.arange(size) < rows[:, None], np.abs(m).max(2), -1)
    keep = (top >= trim * top.max(1, keepdims=True)) & (top >= 0)
    start, end = keep.argmax(1), size - keep[:, ::-1].argmax(1)
    at = start[:, None] + np.arange(size)
    inside, at = (at < end[:, None])[:, :, None], np.minimum(at, size - 1)[:, :, None]
    mass = np.abs(m).sum(2, keepdims=True)
    ppm = np.abs(m) / np.where(mass > 0, mass, 1)
    return Cores(np.where(inside, np.take_along_axis(ppm, at, 1), 0), np.where(inside, np.take_along_axis(m, at, 1), 0), end - start)


def lengths(c: Cores) -> list:
    """Core lengths that occur, and where."""
    return [(int(n), np.flatnonzero(c.length == n)) for n in np.unique(c.length)]


def offsets(la: int, lb: int, least: int, share: float) -> list:
    """Offsets at which cores of two lengths overlap enough: (offset, first and last row + 1 of the overlap in the first core)."""
    found = ((d, max(0, d), min(la, lb + d)) for d in range(1 - lb, la))
    return [(d, s, e) for d, s, e in found if e - s >= max(least, share * la, share * lb)]


def _even(x: np.ndarray, s: int, e: int, by: float = 1.0) -> np.ndarray:
    """Rows s to e of each matrix, flat and of Euclidean length ``by``; zeros stay zeros."""
    x = x[:, s:e].reshape(len(x), -1)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x * (by / np.where(norm > 0, norm, np.inf))[:, None]


UNIT = 10**9  # scores have nine decimals, so they and their sums are whole numbers of units


def _cosines(x: np.ndarray, y: np.ndarray, at: list, out: np.ndarray):
    """For each overlap of ``at``: the cosines in units of each x with each y, in ``out``."""
    for d, s, e in at:
        yield np.matmul(_even(x, s, e, UNIT), _even(y, s - d, e - d).T, out=out)


def _best(a: Cores, b: Cores, at: list):
    """Best score in units of pairs of cores of two lengths, and the place of its overlap in ``at``, taken for '+' and then for '-'."""
    score, now = np.full((len(a.length), len(b.length)), -1.0), np.empty((len(a.length), len(b.length)))
    place, better = np.zeros(score.shape, np.int16 if 2 * len(at) < 2**15 else np.int32), np.empty(score.shape, bool)
    for o, other in enumerate((b.ppm, b.turned(b.ppm))):
        for k, x in enumerate(_cosines(a.ppm, other, at, now), o * len(at)):
            np.rint(x, out=x)
            np.greater(x, score, out=better)
            np.maximum(x, score, out=score)
            np.copyto(place, k, where=better)
    return np.minimum(score, UNIT, out=score), place


def _best_score(a: Cores, b: Cores, at: list) -> np.ndarray:
    """The scores of ``_best`` alone, rounded once the greatest is found."""
    score, now = np.zeros((len(a.length), len(b.length))), np.empty((len(a.length), len(b.length)))
    for other in (b.ppm, b.turned(b.ppm)):
        for x in _cosines(a.ppm, other, at, now):
            np.maximum(x, score, out=score)
    return np.minimum(np.rint(score, out=score), UNIT, out=score)


def _signed(a: Cores, b: Cores, at: list, place: np.ndarray) -> np.ndarray:
    """Cosines in units of the signed matrices of pairs at the overlaps found on the unsigned ones."""
    out, now = np.zeros(place.shape), np.empty(place.shape)
    for o, other in enumerate((b.cwm, b.turned(b.cwm))):
        for k, x in enumerate(_cosines(a.cwm, other, at, now), o * len(at)):
            np.copyto(out, x, where=place == k)
    return np.clip(np.rint(out, out=out), -UNIT, UNIT, out=out)


def best(a: Cores, b: Cores, least: int = LEAST_ROWS, share: float = LEAST_SHARE):
    """Best cosine (-2: none), orientation (0: '+'), offset and overlap of each pair; of equal scores '+' and the least offset."""
    shape = len(a.length), len(b.length)
    score, orient, shift, width = np.full(shape, -2.0), np.zeros(shape, int), np.zeros(shape, int), np.zeros(shape, int)
    for la, i in lengths(a):
        for lb, j in lengths(b):
            if at := offsets(la, lb, least, share):
                x, place = _best(a.of(i, la), b.of(j, lb), at)
                pairs, (d, s, e) = np.ix_(i, j), np.array(at).T
                score[pairs], orient[pairs], shift[pairs], width[pairs] = x / UNIT, place // len(at), d[place % len(at)], (e - s)[place % len(at)]
    return score, orient, shift, width


def best_score(a: Cores, b: Cores, least: int = LEAST_ROWS, share: float = LEAST_SHARE) -> np.ndarray:
    """The scores of ``best`` alone, for pairs that have one."""
    score = np.zeros((len(a.length), len(b.length)))
    for la, i in lengths(a):
        for lb, j in lengths(b):
            if at := offsets(la, lb, least, share):
                score[np.ix_(i, j)] = _best_score(a.of(i, la), b.of(j, lb), at) / UNIT
    return score


EDGE = "source long, target long, orientation string, offset long, overlap_bp long, overlap_frac_source double, overlap_frac_target double, ppm_similarity double, signed_cwm_similarity double"


def usable(motif: str = "embedding"):
    """Whether a motif has a PPM."""
    m = F.col(motif)
    return F.coalesce((F.size(m) > 0) & (F.size(m) % 4 == 0) & F.forall(m, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def core_bp(motif: str = "embedding", trim: float = TRIM):
    """Rows of the core of a usable motif, by the rule of ``cores``; null for another."""
    m, rows = F.col(motif), F.sequence(F.lit(0), F.floor(F.size(motif) / 4).cast("int") - 1)
    tops = F.transform(rows, lambda i: F.array_max(F.transform(F.slice(m, i * 4 + 1, F.lit(4)), F.abs)))
    kept = F.filter(rows, lambda i: F.get(tops, i) >= trim * F.array_max(tops))
    return F.when(usable(motif), F.element_at(kept, -1) - F.element_at(kept, 1) + 1)


#: Tiles of a block, at most, and blocks from which a block has more than one.
TILES, FEW = 8, 32


def _dealt(motifs: DataFrame, tile: int) -> tuple[DataFrame, int]:
    """Usable motifs (node, embedding) in blocks b by range of id, written; the number of blocks.

    A motif travels once for each block, so blocks widen up to ``TILES`` tiles as the motifs grow.
    """
    good = motifs.filter(F.col("node").isNotNull() & usable()).select(F.col("node").cast("long").alias("node"), "embedding")
    n = good.count()
    blocks = max(1, -(-n // (tile * max(1, min(TILES, n // (FEW * tile))))))
    return written(good.repartitionByRange(blocks, "node").withColumn("b", F.spark_partition_id()), "motifs"), blocks


#: Parts of all blocks, at most, and motifs from which a part is divided where the cores do not ask for more parts.
SIDE, WIDE = 64, 8192


def _met(dealt: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Each block beside itself and every other once, in either order, and that for each part of the shuffles.

    A block is one row.  A task reads the blocks of its place in the square of all blocks, so none is copied for the pairs.
    Pairs of blocks lie on both sides of the diagonal, by turns: every task has its share.
    """
    packed = dealt.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("node", "embedding"))).alias("m"))
    one = packed.select("b", "m", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    other = packed.select(F.col("b").alias("o"), F.col("m").alias("o_m"))
    side = min(blocks, SIDE, max(math.ceil((4 * dealt.sparkSession.sparkContext.defaultParallelism) ** 0.5), dealt.count() // WIDE))
    one, other = one.repartitionByRange(min(side * parts, 2 * SIDE), "b", "part"), other.repartitionByRange(side, "o")
    turn = F.when((F.col("b") + F.col("o")) % 2 == 0, F.col("b") <= F.col("o")).otherwise(F.col("b") > F.col("o"))
    return one.hint("shuffle_replicate_nl").join(other.hint("shuffle_replicate_nl"), turn)


def _block(rows, trim: float, tile: int) -> list:
    """Ids and cores of a block (its motifs by id), in tiles of one core length each."""
    ids, motifs, ends = rows.values.field("node").to_numpy(), rows.values.field("embedding"), rows.values.field("embedding").offsets.to_numpy()
    flat, size, found = motifs.values.to_numpy(zero_copy_only=False), np.diff(ends), {}
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        own = cores(flat[ends[at][:, None] + np.arange(n)], trim)
        for length, i in lengths(own):
            found.setdefault(length, []).append((ids[at[i]], own.of(i, length)))
    out = []
    for length, parts in found.items():
        node = np.concatenate([x for x, _ in parts])
        all_, order = Cores(*(np.concatenate([getattr(c, f) for _, c in parts]) for f in ("ppm", "cwm", "length"))), np.argsort(node, kind="stable")
        out += [(node[i], all_.of(i, length)) for i in (order[k : k + tile] for k in range(0, len(order), tile))]
    return out


#: Shuffles that a task runs over one pair of blocks.
AT_ONCE = 25
NULL = "reach long, total long, low long, high long"


def _registered(motifs: DataFrame, shuffles: int, seed: int, least: int, share: float, tile: int, at_once: int, signs: bool, trim: float) -> DataFrame:
    """The columns of EDGE, and with shuffles: draws that reach the observed score, their sum in units, least and greatest."""
    kinds = EDGE.split(", ")[: None if signs else -1]
    names = [c.split()[0] for c in kinds]

    def rows(s, a, t, b, part):
        import pyarrow as pa

        la, lb, kept = int(a.length[0]), int(b.length[0]), s[:, None] < t[None, :]
        at = offsets(la, lb, least, share)
        if not at or not kept.any():
            return
        score, place = _best(a, b, at)
        pick = (lambda x: x.ravel()) if kept.all() else (lambda x: x[kept])
        d, s_, e = (np.tile(x, 2) for x in np.array(at).T)
        where, each = pick(place), (lambda x: pick(np.broadcast_to(x, kept.shape)))
        sign = np.repeat(np.frombuffer(b"+-", np.uint8), len(at))[where]
        sign = pa.StringArray.from_buffers(len(sign), pa.py_buffer(np.arange(len(sign) + 1, dtype=np.int32)), pa.py_buffer(sign))
        values = [each(s[:, None]), each(t[None, :]), sign, d[where], (e - s_)[where], ((e - s_) / la)[where], ((e - s_) / lb)[where], pick(score) / UNIT]
        if signs:
            values.append(pick(_signed(a, b, at, place)) / UNIT)
        out = dict(zip(names, values, strict=True))
        if shuffles:
            reach, total, low, high = np.zeros(kept.shape, np.int64), np.zeros(kept.shape), np.full(kept.shape, 2.0 * UNIT), np.full(kept.shape, -2.0 * UNIT)
            for k in range(part * at_once, min(shuffles, (part + 1) * at_once)):
                x = _best_score(a, b.shuffled(seed, k), at)
                reach += x >= score
                total += x
                np.minimum(low, x, out=low)
                np.maximum(high, x, out=high)
            out |= {"reach": pick(reach), **{c: pick(x).astype(np.int64) for c, x in (("total", total), ("low", low), ("high", high))}}
        yield pa.RecordBatch.from_pydict(out)

    def run(batches):
        for batch in batches:
            for i, o, part, x, y in zip(*(batch.column(c) for c in ("b", "o", "part", "m", "o_m")), strict=True):
                i, o = i.as_py(), o.as_py()
                ours = _block(x if i <= o else y, trim, tile)
                theirs = ours if i == o else _block(y if i <= o else x, trim, tile)
                for t, b in theirs:
                    for s, a in ours:
                        yield from rows(s, a, t, b, part.as_py())

    parts = max(1, -(-shuffles // at_once))
    met = _met(*_dealt(motifs, tile), parts)
    with one_thread(motifs.sparkSession):
        found = met.mapInArrow(run, ", ".join([*kinds, *([NULL] if shuffles else [])]))
    if parts == 1:
        return found
    # every part registers the pair alike
    return found.groupBy(*names).agg(F.sum("reach").alias("reach"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def _summary(shuffles: int, seed: int) -> list:
    unit = lambda c: F.col(c) / F.lit(float(UNIT))
    return [F.lit(shuffles).cast("long").alias("null_shuffles"), F.lit(seed).cast("long").alias("seed"), ((F.col("reach") + 1) / (shuffles + 1)).alias("empirical_p_value"), F.round(unit("total") / shuffles, 9).alias("null_mean"), unit("low").alias("null_min"), unit("high").alias("null_max")]


def null_summary(motifs: DataFrame, shuffles: int, seed: int = 7, least: int = LEAST_ROWS, share: float = LEAST_SHARE, block: int = 256, at_once: int = AT_ONCE, trim: float = TRIM) -> DataFrame:
    """source, target, null_shuffles, seed, empirical_p_value, null_mean, null_min, null_max of every registrable pair."""
    ship(motifs.sparkSession)
    return _registered(motifs, shuffles, seed, least, share, block, at_once, False, trim).select("source", "target", *_summary(shuffles, seed))


def register(motifs: DataFrame, shuffles: int = 0, seed: int = 7, least: int = LEAST_ROWS, share: float = LEAST_SHARE, block: int = 256, at_once: int = AT_ONCE, signs: bool = True, trim: float = TRIM) -> DataFrame:
    """Every registrable pair of motifs (node, embedding), the smaller id as source; with shuffles, its null as well.

    A null draw puts the target core's rows in another order and registers the pair anew, offsets and orientations
    included; p = (draws that reach the observed score + 1) / (draws + 1).  A task registers two tiles of ``block`` motifs at
    a time, and runs ``at_once`` of their shuffles; the shuffles' parts are counts, integer sums, minima and maxima, which add
    up alike however they are cut.  ``trim`` 0 registers motifs that are cores already.
    """
    ship(motifs.sparkSession)
    found = _registered(motifs, shuffles, seed, least, share, block, at_once, signs, trim)
    return found.select(*[c for c in found.columns if c not in ("reach", "total", "low", "high")], *_summary(shuffles, seed)) if shuffles else found


def _motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("node"), "embedding")


def pair_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations of all pairs of motifs, unsigned similarity alone."""
    return register(_motifs(spark, sf_dir), signs=False)


def pair_signed_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed similarity of all pairs at their registration."""
    return register(_motifs(spark, sf_dir)).select("source", "target", "orientation", "offset", "ppm_similarity", "signed_cwm_similarity")


def pair_null_pvalue(spark: SparkSession, sf_dir: str, shuffles: int = 19) -> DataFrame:
    """Null summary of all pairs."""
    pairs = register(_motifs(spark, sf_dir), shuffles, signs=False)
    return pairs.select("source", "target", "null_shuffles", "seed", "empirical_p_value", "null_mean", "null_min", "null_max", F.col("ppm_similarity").alias("observed_ppm_similarity"), F.lit(RULE).alias("registration_rule_version"))
