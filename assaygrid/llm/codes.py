"""Vector codes by Elkan's Lloyd iterations: each part of a vector becomes the number of its nearest codebook entry.

Components become integers, so distances, ties and sums are exact.  Between rounds a written table keeps, beside
each vector's integers and codes, an upper bound of each part's distance to its entry and a lower bound of its distance
to every entry.  Bounds are rounded outwards (upper to 32 bits, lower to 16), and a round first shifts them by how
far entries moved.  A part is left alone if its upper bound is strictly below half the distance from its entry to the
nearest other one; otherwise an entry is left out if its lower bound, or half its distance from the part's entry,
is strictly above the upper bound.  Equality never prunes: what is left is compared by integer distance, then index.

A round reads and writes a table and sums integers for each (part, entry, position) inside tasks before they are shuffled;
what comes to the driver is one codebook (parts x entries x positions).  Codebooks go to the tasks with the code.

Defined cases: null vectors and those with null or non-finite components take no part; null and repeated ids keep their
rows (null ids are last, equal ids by vector, among the first entries); shorter vectors count as padded with zeros to the
longest, and that to a multiple of the parts; fewer rows than entries make fewer entries; equal entries tie to the lower
index; no rows give an empty result; extra columns are ignored.  Components so large that a squared
distance could pass 64 bits are refused with a ValueError (in 64 dimensions, from about 45,000 in absolute value).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that a task works on at a time, and slots into which a label's rows are dealt for the join with its sum.
ROWS, SLOTS = 8192, 16


def up(v: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(v, np.float64).astype(np.float32), np.float32(np.inf))


def down(v: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(v, np.float64).astype(np.float32), np.float32(-np.inf))


def halved(v: np.ndarray) -> np.ndarray:
    """Lower bounds in 16 bits, never above the given ones."""
    h = np.minimum(v, np.float32(65504)).astype(np.float16)
    return np.where(h.astype(np.float32) > v, np.nextafter(h, np.float16(-np.inf)), h)


def square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> int:
    """Nearest entries of one part of many vectors, in place (code, upper, lower); the number of distances worked out."""
    upper[:] = up(upper.astype(np.float64) + moved[code])
    lower[:] = down(lower.astype(np.float64) - moved)
    half = down(np.sqrt(square(entries[:, None], entries[None]).astype(np.float64)) / 2)
    np.fill_diagonal(half, np.inf)
    alone = half.min(1)
    i = np.flatnonzero(upper >= alone[code])
    own = square(x[i], entries[code[i]])
    worked = len(i)
    upper[i] = up(np.sqrt(own.astype(np.float64)))
    lower[i, code[i]] = down(np.sqrt(own.astype(np.float64)))
    still = upper[i] >= alone[code[i]]
    i, own = i[still], own[still]
    if not len(i):
        return worked
    limit = upper[i][:, None]
    row, entry = np.nonzero((lower[i] <= limit) & (half[code[i]] <= limit))
    found = square(x[i[row]], entries[entry])
    lower[i[row], entry] = down(np.sqrt(found.astype(np.float64)))
    all_ = np.full((len(i), len(entries)), np.iinfo(np.int64).max)
    all_[np.arange(len(i)), code[i]] = own
    all_[row, entry] = found
    code[i] = all_.argmin(1)  # the first of equals
    upper[i] = up(np.sqrt(all_.min(1).astype(np.float64)))
    return worked + len(row)


def gathered(batches, rows: int = ROWS):
    """Batches put together until they hold so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cells(table: pa.Table, name: str, dtype, shape: tuple[int, ...]) -> np.ndarray:
    """A binary column of equal lengths as an array that can be written to."""
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype).reshape(table.num_rows, *shape).copy()


def packed(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a], pa.binary())


STATE = "vec_id {id}, label {label}, x binary, code binary, upper binary, lower binary"


def integers(vectors: DataFrame, width: int, scale: int, parts: int) -> DataFrame:
    """vec_id, label and the integers of each vector (32 bits each, the parts after each other)."""

    def run(batches):
        for t in gathered(batches):
            v = t["embedding"].combine_chunks()
            flat, n = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(v.offsets.to_numpy())
            out = np.zeros((len(n), parts * width), np.int64)
            out[np.arange(parts * width) < n[:, None]] = np.floor(scale * flat).astype(np.int64)
            yield from pa.table({"vec_id": t["vec_id"], "label": t["label"], "x": packed(out.astype("<i4"))}).to_batches()

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary")


def assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    """The next state; at last, codes in hex and errors instead."""
    parts, k, width = books.shape
    first = "code" not in state.columns
    kinds = {c: state.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        for t in gathered(batches):
            n = t.num_rows
            x = cells(t, "x", "<i4", (parts, width)).astype(np.int64)
            if first:
                code, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, k), np.float32)
            else:
                code, upper, lower = cells(t, "code", np.uint8, (parts,)), cells(t, "upper", np.float32, (parts,)), cells(t, "lower", np.float16, (parts, k)).astype(np.float32)
            for p in range(parts):
                c, u, low = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                assign(x[:, p], c, u, low, books[p], moved[p])
                code[:, p], upper[:, p], lower[:, p] = c, u, low
            if last:
                error = square(x, books[np.arange(parts), code]).sum(1)
                out = {"vec_id": t["vec_id"], "label": t["label"], "code": pa.array([r.tobytes().hex() for r in code]), "error": pa.array(error)}
            else:
                out = {"vec_id": t["vec_id"], "label": t["label"], "x": t["x"], "code": packed(code), "upper": packed(upper), "lower": packed(halved(lower))}
            yield from pa.table(out).to_batches()

    return state.mapInArrow(run, "vec_id {vec_id}, label {label}, code string, error long".format(**kinds) if last else STATE.format(id=kinds["vec_id"], label=kinds["label"]))


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their parts; unused entries stay."""
    parts, k, width = books.shape

    def run(batches):
        sums, n = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for t in gathered(batches):
            x, code = cells(t, "x", "<i4", (parts, width)).astype(np.int64), cells(t, "code", np.uint8, (parts,))
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=k)
                for j in np.unique(code[:, p]):
                    sums[p, j] += x[code[:, p] == j, p].sum(0)
        p, j, i = (a.ravel() for a in np.indices(sums.shape))
        used = n[p, j] > 0
        p, j, i = p[used], j[used], i[used]
        if len(p):
            yield pa.RecordBatch.from_pydict({"p": pa.array(p, pa.int32()), "j": pa.array(j, pa.int32()), "i": pa.array(i, pa.int32()), "n": pa.array(n[p, j]), "s": pa.array(sums[p, j, i].astype(np.int64))})

    out = books.copy()
    whole = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    for p, j, i, n, s in state.select("x", "code").mapInArrow(run, "p int, j int, i int, n long, s long").groupBy("p", "j", "i").agg(whole("n"), whole("s")).collect():
        out[p, j, i] = int(s) // int(n)
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every vector of (vec_id, label, embedding), written; and the codebooks."""
    spark = common.prepare(table.sparkSession)
    good = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    vectors = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.coalesce(good, F.lit(False)))
    longest, most = vectors.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    kinds = {c: table.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    if longest is None:
        return spark.createDataFrame([], "vec_id {vec_id}, label {label}, code string, error long".format(**kinds)), np.zeros((parts, 0, 0), np.int64)
    width = max(1, -(-longest // parts))
    bound = int(scale * (most or 0)) + 1
    if parts * width * (2 * bound) ** 2 >= 1 << 63 or bound >= 1 << 31:
        raise ValueError(f"components of {most} are too large for distances in 64 bits")
    head = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    books = np.zeros((len(head), parts * width), np.int64)
    for r, row in zip(books, head, strict=True):
        r[: len(row["embedding"])] = np.floor(scale * np.array(row["embedding"], np.float64)).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(len(head), parts, width).transpose(1, 0, 2))
    moved = np.zeros(books.shape[:2])
    state = common.written(integers(vectors, width, scale, parts), "vectors")
    for _ in range(rounds):
        before, state = state, common.written(assigned(state, books, moved, False), "codes")
        common.discard(before)
        now = moved_books(state, books)
        moved, books = up(np.sqrt(square(now, books).astype(np.float64))).astype(np.float64), now
    out = common.written(assigned(state, books, moved, True), "coded")
    common.discard(state)
    return out, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The error summed over equal labels beside each row; a label's rows are dealt into slots, so none is hot in the join."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label").withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    dealt = coded.withColumn("__deal", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SLOTS)).cast("int"))
    return dealt.join(sums, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__deal") == F.col("__slot"))).drop("__label", "__slot", "__deal")


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(common.table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """All distances of all rounds, without bounds."""
    text = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS MATERIALIZED (SELECT rid, (i - 1) // 8 AS part, (i - 1) % 8 AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM kept) k),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, v FROM cell WHERE rid <= 16)"""
    for r in range(1, ROUNDS + 2):
        text += f""",
a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM
  (SELECT c.rid, c.part, b.entry, CAST(sum((c.v - b.v) * (c.v - b.v)) AS BIGINT) AS d FROM cell c JOIN b{r - 1} b ON b.part = c.part AND b.pos = c.pos GROUP BY c.rid, c.part, b.entry) x GROUP BY rid, part)"""
        if r <= ROUNDS:
            text += f""",
b{r} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CAST(CASE WHEN n IS NULL THEN b.v ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS v FROM b{r - 1} b
  LEFT JOIN (SELECT a.part, a.entry, c.pos, sum(c.v) AS s, count(*) AS n FROM a{r} a JOIN cell c ON c.rid = a.rid AND c.part = a.part GROUP BY a.part, a.entry, c.pos) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""
    return text + f""",
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS + 1} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded c JOIN kept k ON k.rid = c.rid"""


OP12_SQL = _sql()
