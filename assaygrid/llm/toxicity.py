"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its words' weights; the
document's score is the noisy-or of its sentences, 1 - prod(1 - p).  Weights are trained through the
noisy-or from document labels alone, after which the sentence scores locate the offending sentences.

Features are a word's lower-case letters whole and its prefixes of 3 to 6 letters, hashed; the features
used are those seen more often in toxic documents than chance explains, by one rule at every sample size.  Training takes about
``texts_per_class`` labelled documents of each class (a documented bound); scoring covers every row and
every whole text.

Defined cases: null and empty texts have one empty sentence and get its score, below 0.5 in any corpus
whose clean documents outnumber the toxic ones or hold more sentences than one; without labels of both
classes the score is the share of toxic labels (0 without labels).  Null labels are ignored, repeated rows
score alike, a very long text is read whole, an empty table gives an empty result, and input columns named
like the result's come back as ``__was_<name>``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
BITS = 20
#: Words whose score a worker remembers.
CACHE = 400_000


def features(token: str) -> list[int]:
    """Hashed features of a white-space token (already lower case): its runs of letters and their prefixes."""
    out = []
    for word in LETTERS.findall(token):
        out.append(zlib.crc32(b"w" + word.encode("utf-8", "replace")) & ((1 << BITS) - 1))
        out += [zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "replace")) & ((1 << BITS) - 1) for n in PREFIXES if len(word) >= n]
    return out


@dataclass
class BagModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    prior: float = 0.0
    trained: bool = False

    def words(self) -> dict:
        return WordScores(self.weights)


class WordScores(dict):
    """Token -> sum of its weights, worked out once."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        get = self.weights.get
        value = self[token] = sum(get(x, 0.0) for x in features(token))
        return value


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score_text(model: BagModel, words: WordScores, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """Document score, and (start, end, score) of the sentences that offend (score 0.5 or more)."""
    if not model.trained:
        return model.prior, []
    lower = (text or "").lower()
    get, plain, clean, hits = words.__getitem__, 0, 0.0, []
    for m in SENTENCE.finditer(lower):
        x = sum(map(get, m.group().split()))
        if x:
            p = float(sigmoid(x + model.bias))
            clean += np.log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                hits.append((m.start(), m.end(), p))
        else:
            plain += 1
    clean += max(plain, 1 if not lower.strip() else 0) * np.log1p(-sigmoid(model.bias))
    return float(min(1.0, max(0.0, 1 - np.exp(clean)))), hits


def train(bags: list[list[np.ndarray]], labels: np.ndarray, rounds: int = 300, decay: float = 0.04) -> BagModel:
    """Weights by gradient ascent (Adam) on the noisy-or likelihood; a bag: per sentence its selected features.

    The likelihood is a mean over documents, so the decay is divided by their number: a word of a few documents
    then counts alike in a small and in a large sample.
    """
    prior = float(labels.mean()) if len(labels) else 0.0
    if not len(labels) or labels.min() == labels.max():
        return BagModel(prior=prior)
    vocab, flat = np.unique(np.concatenate([s for b in bags for s in b] or [np.zeros(0, np.int64)]), return_inverse=True)
    lens = np.array([len(s) for b in bags for s in b])
    sent = np.repeat(np.arange(len(lens)), lens)
    per = np.array([len(b) for b in bags])
    doc = np.repeat(np.arange(len(bags)), per)
    weight = np.where(labels == 1, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9)) / len(labels)
    w, bias = np.zeros(len(vocab) + 1), -4.0
    m = v = np.zeros(len(vocab) + 1)
    for step in range(1, rounds + 1):
        w[-1] = bias if step == 1 else w[-1]
        z = np.bincount(sent, weights=w[flat], minlength=len(lens)) + w[-1]
        p = sigmoid(z)
        miss = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags))
        bag = np.clip(1 - np.exp(miss), 1e-9, 1 - 1e-9)
        # d loglik / dz = p * (y - P) / P
        g = p * ((labels - bag) / bag * weight)[doc]
        grad = np.append(np.bincount(flat, weights=g[sent], minlength=len(vocab)), g.sum())
        grad[:-1] -= decay / len(labels) * w[:-1] / max(1, len(vocab)) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    keep = {int(k): float(x) for k, x in zip(vocab, w[:-1], strict=True) if abs(x) > 1e-3}
    return BagModel(keep, float(w[-1]), prior, True)


def select(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> set[int]:
    """Features whose document counts differ between the labels by more than three standard errors, at every sample size."""
    a, b = toxic / max(1, n_toxic), clean / max(1, n_clean)
    both = (toxic + clean) / max(1, n_toxic + n_clean)
    z = (a - b) / np.sqrt(both * (1 - both) * (1 / max(1, n_toxic) + 1 / max(1, n_clean)) + 1e-12)
    return set(np.flatnonzero((z > 3.0) & (toxic >= 2) & (a > 4 * b)).tolist())


def fit(docs: DataFrame, labels: DataFrame, texts_per_class: int = 6000, seed: int = 7, label: str = "toxic", folds: int = 8) -> BagModel:
    """Model from docs (doc_id, text) and labels (doc_id, label), both already cut to the learnable rows; texts of more than ``common.LEARN_BYTES`` teach nothing."""
    common.prepare(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    sample = common.bounded_sample(known, "y", texts_per_class, F.col("doc_id"), seed)
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= common.LEARN_BYTES).join(F.broadcast(sample), "doc_id").select("text", "y")
    rows = common.at_most_of(rows, "y", 2 * texts_per_class, seed)  # an id of many documents would swell the sample
    rows = common.written(rows.repartition(folds), "labelled")  # bounded; read twice below

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = {0: np.zeros(1 << BITS, np.int32), 1: np.zeros(1 << BITS, np.int32)}, {0: 0, 1: 0}
        known: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y] += 1
                own: set[int] = set()
                for token in set(t.lower().split()):
                    if token not in known:
                        if len(known) >= CACHE:
                            known.clear()
                        known[token] = features(token)
                    own.update(known[token])
                seen[y][list(own)] += 1
        yield pa.RecordBatch.from_pydict({"y": pa.array([0, 1], pa.int32()), "n": pa.array([n[0], n[1]], pa.int64()), "seen": [zlib.compress(seen[y].tobytes(), 1) for y in (0, 1)]})

    total, n = {0: np.zeros(1 << BITS, np.int64), 1: np.zeros(1 << BITS, np.int64)}, {0: 0, 1: 0}
    for r in rows.mapInArrow(count, "y int, n long, seen binary").collect():  # one small row for each fold and label
        total[r.y] += np.frombuffer(zlib.decompress(r.seen), np.int32)
        n[r.y] += r.n
    chosen = select(total[0], total[1], n[0], n[1])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                sents = [[x for token in m.group().split() for x in features(token) if x in chosen] for m in SENTENCE.finditer(t.lower())]
                out.append(sents or [[]])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["y", "bag"])

    data = rows.mapInArrow(bags, "y int, bag array<array<int>>").collect()
    data.sort(key=lambda r: (r.y, r.bag))
    return train([[np.array(s, np.int64) for s in r.bag] for r in data], np.array([r.y for r in data]))


def predict(docs: DataFrame, model: BagModel, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and offending, the (start, end, score) of sentences that offend, in characters of the lower-cased text."""
    common.prepare(docs.sparkSession)
    docs, _ = common.apart(docs, ("score", "offending"))
    kept = [f.name for f in docs.schema]
    place = kept.index(text)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words()
        for batch in batches:
            found = [score_text(model, words, t) for t in batch.column(place).to_pylist()]
            spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in hits] for _, hits in found], span)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.float64()), spans], names=[*kept, "score", "offending"])

    offending = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", offending)]))


def op4_sentence_bags(spark: SparkSession, sf_dir: str, at_least: float = 0.7) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.filter(common.id_crc() % 3 != 1))
    out = predict(docs, model)
    return out.select("doc_id", (common.id_crc() % 3 == 1).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"), "offending")
