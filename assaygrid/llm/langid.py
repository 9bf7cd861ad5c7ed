"""Language identification by mixture inference.

A document is read as a mixture of languages.  Every word gets a likelihood under each language from its
letter trigrams (word ends included); expectation-maximisation over the words gives the document's language
proportions; the set of languages is the nested set with the best penalised likelihood (half of ``penalty``
times log(words) for each language after the first), and the proportions are fitted again on that set.

The trigram counts come from labelled texts: about ``docs_per_lang`` of each language (a documented bound;
all of them where there are fewer).  Prediction covers every row and every whole text.

Defined cases: null text, empty text and text without a letter get ``und`` with score 0 and an empty
mixture; so does every text if no labelled text has a letter.  Repeated rows are scored alike.  A very long
text is read whole, as one block.  An empty table gives an empty result, and a model without languages.
Extra columns pass through untouched; those named like the result's come back as ``__was_<name>``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of text handled at a time; bounds the memory of the per-letter arrays.
BLOCK = 1 << 18


def _codes() -> np.ndarray:
    """Byte -> code: 0 separates words; ASCII letters and bytes of multi-byte letters have codes of their own."""
    code = np.zeros(256, dtype=np.uint32)
    letters = [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]
    code[letters] = np.arange(1, len(letters) + 1)
    return code


CODE = _codes()


@dataclass
class MixtureModel:
    langs: list[str]
    logp: np.ndarray  # (buckets, languages), float32

    @property
    def bits(self) -> int:
        return int(self.logp.shape[0]).bit_length() - 1


def trigrams(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each letter byte: its place and the bucket of the trigram around it."""
    c = np.concatenate([[0], CODE[data], [0]]).astype(np.uint32)
    at = np.flatnonzero(c[1:-1])
    g = (c[at] * np.uint32(163) + c[at + 1]) * np.uint32(163) + c[at + 2]
    return at, ((g * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Runs of texts as one byte array, with the start of each text; every text with a letter is in one run."""
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0

    def out():
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        return ids, np.frombuffer(b"\n".join(parts), dtype=np.uint8), starts

    for i, t in enumerate(texts):
        if t and LETTER.search(t):
            b = t.lower().encode("utf-8", "replace")
            if parts and size + len(b) > BLOCK:
                yield out()
                ids, parts, size = [], [], 0
            ids.append(i)
            parts.append(b)
            size += len(b) + 1
    if parts:
        yield out()


def _em(p: np.ndarray, w: np.ndarray, pi: np.ndarray, doc: np.ndarray, first: np.ndarray, total: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        r = p * pi[doc]
        r *= (w / np.maximum(r.sum(1), 1e-30))[:, None]
        pi = np.add.reduceat(r, first, axis=0) / total[:, None]
    return pi


def mixtures(model: MixtureModel, texts: list[str | None], rounds: int = 8, penalty: float = 4.0) -> list[np.ndarray | None]:
    """Language proportions of each text, None where it has no letter."""
    out: list[np.ndarray | None] = [None] * len(texts)
    k = len(model.langs)
    if not k:
        return out
    for ids, data, starts in blocks(texts):
        at, grams = trigrams(data, model.bits)
        if not len(at):
            continue
        head = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        ll = np.add.reduceat(model.logp[grams], head, axis=0)
        w = np.diff(head, append=len(at)).astype(np.float32)
        doc_all = np.searchsorted(starts, at[head], side="right") - 1
        present, first = np.unique(doc_all, return_index=True)
        doc = np.searchsorted(present, doc_all)
        p = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -40)).astype(np.float32)
        total = np.add.reduceat(w, first)
        words = np.diff(first, append=len(doc))
        pi = np.full((len(present), k), 1 / k, dtype=np.float32)
        pi = _em(p, w, pi, doc, first, total, rounds)
        rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1, kind="stable")
        best, size = np.full(len(present), -np.inf), np.ones(len(present), dtype=int)
        for n in range(1, k + 1):
            some = np.where(rank < n, np.maximum(pi, 1e-6), 0)
            some /= some.sum(1, keepdims=True)
            fit = np.add.reduceat(np.log(np.maximum((p * some[doc]).sum(1), 1e-30)), first) - 0.5 * penalty * (n - 1) * np.log(words + 1)
            size = np.where(fit > best + 1e-6, n, size)
            best = np.maximum(fit, best)
        pi = np.where(rank < size[:, None], np.maximum(pi, 1e-6), 0).astype(np.float32)
        pi = _em(p, w, pi / pi.sum(1, keepdims=True), doc, first, total, 3)
        for j, d in enumerate(present):
            out[ids[d]] = pi[j]
    return out


def fit(docs: DataFrame, docs_per_lang: int = 4000, bits: int = 17, seed: int = 11) -> MixtureModel:
    """Trigram model of the languages in ``docs`` (columns doc_id, text, lang), from about docs_per_lang texts of each."""
    common.prepare(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = common.bounded_sample(known, "lang", docs_per_lang, F.xxhash64("doc_id", "text"), seed).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = found.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for _, data, _ in blocks([t for x, t in zip(langs, texts, strict=True) if x == lang]):
                    own += np.bincount(trigrams(data, bits)[1], minlength=1 << bits)
        if found:
            yield pa.RecordBatch.from_pydict({"lang": list(found), "counts": [zlib.compress(v.astype("<i8").tobytes(), 1) for v in found.values()]})

    rows = sample.repartition(8).mapInArrow(count, "lang string, counts binary").collect()
    langs = sorted({r.lang for r in rows})
    counts = np.zeros((1 << bits, len(langs)))
    for r in rows:
        counts[:, langs.index(r.lang)] += np.frombuffer(zlib.decompress(r.counts), dtype="<i8")
    keep = counts.sum(0) > 0
    langs, counts = [x for x, ok in zip(langs, keep, strict=True) if ok], counts[:, keep]
    smooth = counts + 0.02
    return MixtureModel(langs, np.log(smooth / smooth.sum(0)).astype(np.float32))


def predict(docs: DataFrame, model: MixtureModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (share of lang_pred in the mixture) and mixture (language -> share)."""
    common.prepare(docs.sparkSession)
    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    docs, _ = common.apart(docs, ("lang_pred", "score", "mixture"))
    kept = [f.name for f in docs.schema]
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pis = mixtures(model, batch.column(place).to_pylist())
            top = [None if x is None else int(np.argmax(x)) for x in pis]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([UNKNOWN if i is None else model.langs[i] for i in top], pa.string()),
                    pa.array([0.0 if i is None else min(1.0, float(x[i])) for i, x in zip(top, pis, strict=True)], pa.float64()),
                    pa.array([[] if x is None else [(model.langs[j], float(x[j])) for j in np.flatnonzero(x)] for x in pis], pa.map_(pa.string(), pa.float64())),
                ],
                names=[*kept, "lang_pred", "score", "mixture"],
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new.fields]))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id, mod 5, is not 0."""
    return docs.filter(common.id_crc() % 5 != 0)


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(learnable(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (common.id_crc() % 5 == 0).alias("held_out"), "lang_pred", "score", "mixture")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which no language is found go; the others keep their columns.

    Where no labelled text teaches a language, there is nothing to judge by and every document stays.
    """
    model = fit(learnable(docs))
    if not model.langs:
        return docs
    docs, restore = common.apart(docs, ("lang_pred", "score", "mixture"))
    return restore(predict(docs, model).filter(F.col("lang_pred") != UNKNOWN))
