"""Spelling variants: every word's full neighbourhood is generated and hash-joined to the vocabulary.

Words are runs of letters with A-Z lower-cased, counted over all documents.  For each word of the vocabulary
all distinct deletions, replacements and insertions over the observed alphabet are generated, as 64-bit hashes
worked out in numpy from running sums, so an edit costs the same in a word of any length.  What is in the
vocabulary is near by construction; no distance is computed.  Hashes that a bit table of the vocabulary rules
out are not shuffled (it only drops candidates that no word has); the others are joined to the vocabulary by
hash, and the word that the edit gives is compared with the word found, which makes hash collisions harmless.

A candidate row is a few numbers, whatever the word's length.  A join key is the hash of one word, and at
most the neighbourhood of that word shares it, so no key is hot.  The bit table has 32 to 64 bits a word and at most
``BITS`` (32 MB); in a larger vocabulary it only rules out less.  Chains of forms are followed by pointer
doubling: a form occurs at least ``ratio`` times as often as its word, so the greatest count bounds their length.

Defined cases: null and empty texts hold no words; a null id counts as the empty text in the deletion rule;
repeated rows count again; ties between forms go to the smallest word in code-point order; one giant word
costs memory in proportion to its length; no documents give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import mixed

#: Letters of a word; all of them are single bytes in Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
BITS = 1 << 28
#: Cells of a word x place table that a worker edits at a time: so few that the processor's cache holds them.
CELLS = 1 << 14
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_PUT = np.array([*map(chr, range(256)), ""], dtype=object)
_BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)


def powers(n: int) -> np.ndarray:
    p = np.full(n + 1, _BASE, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def by_length(words: list[str]):
    """Places of words of one length and their letters as a table of bytes, in parts of at most CELLS cells."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        n = int(size[order[a]])
        step = max(1, CELLS // max(1, n))
        for x in range(a, b, step):
            at = order[x : min(b, x + step)]
            yield at, np.frombuffer("".join([words[i] for i in at]).encode("latin-1"), np.uint8).reshape(len(at), n)


def hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for at, cells in by_length(words):
        n = cells.shape[1]
        out[at] = (_VALUE[cells] * powers(n)[:n]).sum(1, dtype=np.uint64)
    return out


def edits(cells: np.ndarray, alphabet: np.ndarray):
    """Hashes of all distinct edits of words of one length: (hashes, which of them count, letters cut, letter put or -1).

    Tables have a row for each word and a column for each place.  A letter cut from a run of equal letters
    counts once, and so does a letter put beside its equal.
    """
    k, n = cells.shape
    p = powers(n + 1)
    v = _VALUE[cells] * p[:n]
    upto = np.zeros((k, n + 1), np.uint64)
    np.cumsum(v, axis=1, out=upto[:, 1:])
    total = upto[:, -1:]
    again = np.zeros((k, n + 1), bool)  # the letter at a place equals the one before it
    again[:, 1:n] = cells[:, 1:] == cells[:, :-1]
    yield upto[:, :-1] + (total - upto[:, 1:]) * _INVERSE, ~again[:, :n], 1, -1
    rest, moved = total - v, upto + (total - upto) * np.uint64(_BASE)
    for x in alphabet.tolist():
        fresh = np.ones((k, n + 1), bool)
        np.not_equal(cells, x, out=fresh[:, 1:])
        put = _VALUE[x] * p[: n + 1]
        yield rest + put[:n], fresh[:, 1:], 1, x
        yield moved + put, fresh, 0, x


def held(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> np.uint64(3)] & _BIT[place & np.uint64(7)]) != 0


def kept(table: np.ndarray, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells whose hash has both its bits in the table; the second bit is looked up only where the first is there."""
    bits = (len(table) * 8).bit_length() - 1
    i, j = np.nonzero(held(table, h >> np.uint64(64 - bits)) & counts)
    keep = held(table, h[i, j] >> np.uint64(64 - 2 * bits) & np.uint64(len(table) * 8 - 1))
    return i[keep], j[keep]


def word_counts(docs: DataFrame, least_length: int = 7, least: int = 2, run: Column | None = None) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least least_length letters and least occurrences in all documents.

    ``run`` rewrites a run (columns doc_id and run) before it is counted; it may shorten it.
    """
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    found = found.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = found.select((F.col("run") if run is None else run).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def blocks(pdfs, letters: int = 1 << 18):
    """Batches put together until they hold so many letters, so that words of one length fill a table."""
    import pandas as pd

    held, size = [], 0
    for pdf in pdfs:
        held.append(pdf)
        size += int(pdf["word"].str.len().sum())
        if size >= letters:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def hashed_vocabulary(counts: DataFrame) -> DataFrame:
    """id, word, n, h: each distinct word with an id and its hash, written."""

    def run(pdfs):
        for pdf in blocks(pdfs):
            pdf["h"] = hashes(pdf["word"].tolist()).view(np.int64)
            yield pdf

    numbered = counts.select(F.monotonically_increasing_id().alias("id"), "word", "n")
    return common.written(numbered.mapInPandas(run, "id long, word string, n long, h long"), "vocabulary")


def bit_table(vocabulary: DataFrame, words: int) -> np.ndarray:
    """Bits of the vocabulary's hashes: 32 for each word, rounded up, and at most BITS."""
    size = min(BITS, 1 << max(10, (32 * words - 1).bit_length()))
    bits, h = size.bit_length() - 1, F.col("h")
    place = F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(h, 64 - 2 * bits).bitwiseAND(F.lit(size - 1))))
    spread = vocabulary.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
    got = spread.toArrow()
    table = np.zeros(size >> 6, np.int64)
    table[got["at"].to_numpy()] = got["b"].to_numpy()
    return table.view(np.uint8)


def candidates(vocabulary: DataFrame) -> DataFrame:
    """h, source, place, cut, put: every distinct edit of every word whose hash the vocabulary may hold."""
    spark = vocabulary.sparkSession
    alphabet = np.array(sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()), np.int64)  # at most 90 letters
    shared = spark.sparkContext.broadcast((bit_table(vocabulary, vocabulary.count()), alphabet))

    def run(pdfs):
        import pandas as pd

        table, alphabet = shared.value
        for pdf in blocks(pdfs):
            ids, out = pdf["id"].to_numpy(), []
            for at, cells in by_length(pdf["word"].tolist()):
                for h, counts, cut, put in edits(cells, alphabet):
                    i, j = kept(table, h, counts)
                    if len(i):
                        out.append((h[i, j].view(np.int64), ids[at[i]], j, np.full(len(i), cut), np.full(len(i), put)))
            if out:
                h, source, place, cut, put = map(np.concatenate, zip(*out, strict=True))
                yield pd.DataFrame({"h": h, "source": source, "place": place, "cut": cut, "put": _PUT[put]})

    return vocabulary.select("id", "word").mapInPandas(run, "h long, source long, place int, cut int, put string")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """source, near, near_n: each word's id with every word one edit away."""
    return candidates(vocabulary).join(vocabulary.select("h", F.col("word").alias("near"), F.col("n").alias("near_n")), "h").drop("h")


def variants(docs: DataFrame, least_length: int = 7, least: int = 2, ratio: int = 10, run: Column | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    common.prepare(docs.sparkSession)
    vocabulary = hashed_vocabulary(word_counts(docs, least_length, least, run))
    made = F.concat(F.expr("substring(word, 1, place)"), "put", F.expr("substring(word, place + 1 + cut)"))
    right = F.col("near") == made
    best = F.min(F.when(right, F.struct(-F.col("near_n"), F.col("near"))))
    grouped = vocabulary.drop("h").join(near_pairs(vocabulary), F.col("id") == F.col("source"), "left").groupBy("id", "word", "n").agg(F.count(F.when(right, 1)).alias("n_near"), best.alias("best"))
    often = -F.col("best.col1") >= ratio * F.col("n")
    forms = common.written(grouped.select("word", "n", "n_near", F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.col1")).alias("form_n")), "forms")
    most = forms.agg(F.max("form_n")).first()[0]
    hops, far = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), 1
    while most is not None and least * ratio ** (far + 1) <= most:  # a chain of far + 1 forms can be
        ahead = hops.select(F.col("word").alias("to"), F.col("to").alias("further"))
        hops = common.written(hops.join(ahead, "to", "left").select("word", F.coalesce("further", "to").alias("to")), "hops")
        far *= 2
    return forms.join(hops, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


def misspelt() -> Column:
    """The run, without one letter where 31 divides the crc32 of id and run: a rule that plants misspellings."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    cut = F.pmod(h, F.length("run").cast("long")).cast("int")
    return F.when(h % 31 == 0, F.concat(F.col("run").substr(F.lit(1), cut), F.col("run").substr(cut + 2, F.length("run")))).otherwise(F.col("run"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"), run=misspelt()).select("word", "form", "root", "n", "n_near", "form_n")


# crc32 bit by bit: the checking dialect lacks the function.  Near words share a pattern with one letter left out.
OP11_SQL = r"""
WITH runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
once AS (SELECT d, run, count(*) AS n, hex(encode(d || ':' || run)) AS x FROM runs GROUP BY d, run),
bits AS (SELECT *, list_transform(range(0, length(x) * 4), lambda i: (CAST('0x' || x[(i // 8) * 2 + 1:(i // 8) * 2 + 2] AS BIGINT) >> (i % 8)) & 1) AS bit FROM once),
crcs AS (SELECT d, run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bit), lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM bits),
word AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM crcs),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, word[:i] || '-' || word[i + 2:] AS hole, word[:i] || word[i + 2:] AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN vocab b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN vocab b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min({'w': near, 'n': near_n}, {'n': -near_n, 'w': near}) AS f FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 10 * v.n THEN f.w END AS form, CASE WHEN f.n >= 10 * v.n THEN f.n END AS form_n FROM vocab v LEFT JOIN best b ON b.word = v.word),
chain AS (
  WITH RECURSIVE c(word, here, up) AS (SELECT word, word, form FROM forms UNION ALL SELECT c.word, c.up, f.form FROM c JOIN forms f ON f.word = c.up)
  SELECT word, here AS root FROM c WHERE up IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN chain c ON c.word = f.word"""
