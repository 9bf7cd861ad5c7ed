"""License scans: short notices found in whole texts with bounded errors, and exact phrases.

A text is lower-cased (A-Z) and read as words; its words, joined by single spaces, are searched.  A notice of n
characters may have n // 12 errors k (inserted, deleted, replaced characters).  It is split into k + 1 pieces:
k errors leave one of them whole, so the places of exact pieces, found for all notices in one pass of an
Aho-Corasick automaton, miss nothing.  Around each such place lies a window as long as the notice and its
errors, cut at word ends; the regex library's bounded-error matching verifies it and gives span and errors.
Spans begin and end with whole words.  Windows that repeat are verified once for each worker's cache.

Exact phrases are found by the same automaton and count wherever their words stand consecutively.  Of spans of one
notice that overlap, those with fewest errors stay, then the first ones.

Defined cases: a null text is the empty text, without words and matches; texts are scanned whole, in memory in
proportion to the longest one; repeated rows and null ids are scanned each on their own; no documents give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Short notices in their published wording, as words, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution", "cc"),
    ("licensed under cc by 4 0", "cc"),
    ("licensed under cc by sa 4 0", "cc"),
    ("licensed under cc by nc 4 0", "cc"),
)
SPREAD = 12
#: Bytes that are no part of a word become spaces, A-Z become a-z.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
MATCH = "label string, notice string, exact boolean, first_word long, words long, edits int, text string"
_TYPE = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("exact", pa.bool_()), ("first_word", pa.int64()), ("words", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    exact: bool

    @property
    def errors(self) -> int:
        return 0 if self.exact else len(self.text) // SPREAD

    def pieces(self) -> list[tuple[int, str]]:
        """k + 1 pieces of about equal length, and where they begin."""
        cuts = [len(self.text) * i // (self.errors + 1) for i in range(self.errors + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases, notices):
        import ahocorasick

        self.notices = [Notice(t, label, True) for t, label in phrases] + [Notice(t, label, False) for t, label in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for at, piece in n.pieces():
                places.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        # a search gives up where its first letter is an insertion, so windows are searched from both ends
        self.patterns = [[regex.compile(rf"{way} (?:{n.text}){{e<={n.errors}}} ") for way in ("(?b)", "(?br)")] for n in self.notices]
        self.verify = functools.lru_cache(1 << 15)(self.verified)

    def verified(self, i: int, window: bytes) -> tuple[int, int, int] | None:
        """Bytes before the best span, its bytes and its errors.  The spaces around it are exact, so errors can lie at both ends."""
        text = f" {window.decode()} "
        found = [m for p in self.patterns[i] if (m := p.search(text))]
        if not found:
            return None
        m = min(found, key=lambda m: (sum(m.fuzzy_counts), m.span()))
        return len(text[: m.start()].encode()), len(m[0].encode()) - 2, sum(m.fuzzy_counts)

    def spans(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) in words joined by spaces."""
        out, found, end = [], {}, len(data)
        for last, (size, where) in self.seeds.iter(data.decode("latin-1")):
            first = last + 1 - size
            for i, at in where:
                n = self.notices[i]
                if n.exact:
                    if (first == 0 or data[first - 1] == 32) and (last + 1 == end or data[last + 1] == 32):
                        out.append((i, first, last + 1, 0))
                    continue
                far = 4 * n.errors  # bytes of so many characters
                a, b = max(0, first - at - far), min(end, first - at + len(n.text) + far)
                if a and data[a - 1] != 32:
                    a = data.find(b" ", a, b) + 1 or b
                if b < end and data[b] != 32:
                    b = data.rfind(b" ", a, b)
                if a < b and (m := self.verify(i, data[a:b])):
                    found.setdefault(i, {}).setdefault((a + m[0], a + m[0] + m[1]), m[2])
        for i, spans in found.items():
            starts: list[int] = []
            ends: list[int] = []
            for (a, b), edits in sorted(spans.items(), key=lambda x: (x[1], x[0])):
                k = bisect.bisect(starts, a)
                if (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b):
                    starts.insert(k, a)
                    ends.insert(k, b)
                    out.append((i, a, b, edits))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def scan(self, text: bytes | None) -> tuple[int, list[dict]]:
        words = (text or b"").translate(_WORDS).split()
        data = b" ".join(words)
        found = self.spans(data)
        if not found:
            return len(words), []
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        rows = []
        for i, a, b, edits in found:
            n, first = self.notices[i], int(np.searchsorted(gaps, a))
            rows.append({"label": n.label, "notice": n.text, "exact": n.exact, "first_word": first, "words": int(np.searchsorted(gaps, b)) - first + 1, "edits": edits, "text": data[a:b].decode()})
        return len(words), rows


@functools.cache
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    """One scanner for each worker process."""
    return Scanner(phrases, notices)


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, n_words, matches (label, notice, exact, first word, words, errors and text of each span) of every document."""
    common.prepare(docs.sparkSession)

    def run(batches):
        tool = scanner(phrases, notices)
        for b in batches:
            got = [tool.scan(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([m for _, m in got], _TYPE)], ["doc_id", "n_words", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, matches array<struct<{MATCH.replace(' ', ':').replace(',:', ', ')}>>")


def labelled(scanned: DataFrame, errors: dict[str, int] | None = None) -> DataFrame:
    """One row for each document: its phrases, labels and score (1 less the share of allowed errors that its best span takes)."""
    base = F.filter("matches", lambda m: m["exact"])
    starts = F.transform(base, lambda m: m["first_word"])
    names = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    score = F.transform("matches", lambda m: F.when(m["exact"], F.lit(1.0)).otherwise(1 - m["edits"] / (F.floor(F.length(m["notice"]) / SPREAD) + 1)))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), F.coalesce(F.array_max(score), F.lit(0.0)).alias("score"))


def op13_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(scan(common.table(spark, sf_dir, "documents")))
