"""Spelling variants, vector codes and license scans against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from assaygrid.llm import codes, licenses, packing, spelling, tokens

SCHEMA = "doc_id long, text string, lang string, source string, word string, n int, near string, matches string, h long"


def rows(texts):
    return [(i, t, "aa", "s", "w", 1, "x", "y", 2) for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = ["balloon", "library", "Économie", "straße", "ÀÉÎÕÜæøþ", "mississippi", "aaaaaaa", "aaaaaaaa", "notebook", "notebooks", "notebok"]
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(6, 9)))
    pool = base + [word() for _ in range(60)]

    def bent(w):
        i = rng.randrange(len(w))
        return w[:i] + rng.choice(["", "a", "é", w[i] + "b"]) + w[i + 1 :]

    out = []
    for i in range(80):
        n = rng.choice([0, 3, 60, 120])
        out.append((i, " ".join(bent(w) if rng.random() < 0.1 else w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, [30] * 5 + [3] * (len(pool) - 5), k=n))))
    return [*out, (90, None), (91, ""), (None, "balloon balloons library"), (92, "x" * 3000), (93, "x" * 3000 + " ab1notebook2 " + "x" * 3001), (5, out[5][1]), (5, out[5][1]), (94, " ".join(["notebook"] * 400))]


def edited(w, letters):
    for i in range(len(w)):
        yield w[:i] + w[i + 1 :]
        for x in letters:
            yield w[:i] + x + w[i + 1 :]
    for i in range(len(w) + 1):
        for x in letters:
            yield w[:i] + x + w[i:]


def test_neighbourhoods_are_whole_and_distinct():
    """Hashes of the generated edits are those of all distinct edits, each once."""
    for w in ["aab", "abcabc", "zzzz", "a", "éàé"]:
        alphabet = sorted(set(w) | set("abé"))
        want = set(edited(w, alphabet)) - {w}
        got = []
        for h, counts, cut, put in spelling.edits(np.array([[ord(c) for c in w]], np.uint8), np.array([ord(c) for c in alphabet])):
            for j in np.flatnonzero(counts[0]):
                made = w[:j] + ("" if put < 0 else chr(put)) + w[j + cut :]
                got.append(made)
                if made:
                    assert spelling.hashes([made])[0] == h[0, j]
        assert sorted(got) == sorted(want)


def test_variants_of_all_words(spark, texts):
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in spelling.variants(docs, run=spelling.misspelt()).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    n = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    letters = sorted({c for w in n for c in w})
    forms, want = {}, {}
    for w, k in n.items():
        near = {x for x in (edited(w, letters) if len(w) < 100 else ["x" * (len(w) - 1), "x" * (len(w) + 1)]) if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 10 * k else None
        want[w] = [k, len(near), forms[w], forms[w] and n[forms[w]]]
    for w in n:
        at = w
        while forms[at]:
            at = forms[at]
        want[w].append(at)
    assert got == {w: tuple(v) for w, v in want.items()}
    assert sum(v[2] is not None for v in got.values()) > 5
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_chains_of_forms(spark):
    """Each form occurs ten times as often as the one before it; the root is the last, five forms on."""
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    docs = spark.createDataFrame(rows([(0, " ".join(w for k, w in enumerate(words) for _ in range(2 * 10**k)))]), SCHEMA)
    assert {r.word: r.root for r in spelling.variants(docs).collect()} == dict.fromkeys(words, words[-1])


def test_bit_table_of_any_size_loses_nothing(spark, texts, monkeypatch):
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    whole = {r[0]: tuple(r) for r in spelling.variants(docs).select("word", "n", "n_near", "form").collect()}
    monkeypatch.setattr(spelling, "BITS", 1 << 7)
    assert {r[0]: tuple(r) for r in spelling.variants(docs).select("word", "n", "n_near", "form").collect()} == whole


def test_pruned_assignment_is_the_plain_one():
    """Many rounds with kept bounds, ties and equal entries included, against all distances."""
    rng = np.random.default_rng(4)
    for spread in (2, 9, 4000):
        x = rng.integers(-spread, spread, (600, 3))
        entries = x[:7].copy()
        entries[5] = entries[2]
        code, upper, lower, moved, worked = np.zeros(600, np.uint8), np.full(600, np.inf, np.float32), np.zeros((600, 7), np.float32), np.zeros(7), 0
        for _ in range(8):
            worked += codes.assign(x, code, upper, lower, entries, moved)
            d = ((x[:, None] - entries) ** 2).sum(2)
            assert (code == d.argmin(1)).all()
            assert (upper.astype(np.float64) >= np.sqrt(d[np.arange(600), code])).all() and (lower <= np.sqrt(d)).all()
            lower = codes.halved(lower).astype(np.float32)
            assert (lower <= np.sqrt(d)).all()
            now = entries.copy()
            for j in range(7):
                if (code == j).any():
                    now[j] = x[code == j].sum(0) // (code == j).sum()
            moved, entries = codes.up(np.sqrt(((now - entries) ** 2).sum(1).astype(np.float64))).astype(np.float64), now
        assert worked < 8 * 600 * 7


def plain_codes(kept, parts=8, k=16, rounds=6):
    """kept: (id, label, integers)."""
    x = np.array([v for _, _, v in kept]).reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:k]
    books = np.stack([x[order, p] for p in range(parts)])
    for r in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        code = d.argmin(2)
        if r == rounds:
            break
        for p in range(parts):
            for j in range(books.shape[1]):
                if (code[:, p] == j).any():
                    books[p, j] = [s // int((code[:, p] == j).sum()) for s in x[code[:, p] == j, p].sum(0).tolist()]
    error = d.min(2).sum(1)
    by = collections.Counter()
    for (_, label, _), e in zip(kept, error.tolist(), strict=True):
        by[label] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, bytes(c.tolist()).hex(), e, by[label], sha) for (i, label, _), c, e in zip(kept, code.astype(int), error.tolist(), strict=True)), key=repr)


def test_codes_of_a_table_with_odd_rows(spark):
    rng = np.random.default_rng(9)
    data = [(int(i), rng.normal(0, 0.3, 64).astype(np.float32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(200)]
    data += [(3, data[7][1], 1), (3, data[7][1], 1), (None, data[8][1], None), (900, None, 1), (901, [math.nan] + data[0][1][1:], 1), (902, [None] + data[0][1][1:], 1), (903, [math.inf] + data[0][1][1:], 2), (904, [0.5, -0.25], 0), (905, [], 0)]
    table = spark.createDataFrame([(*r, "e", 1, "c") for r in data], "vec_id long, embedding array<float>, label int, code string, error int, x string").repartition(3)
    coded, books = codes.compress(table)
    got = sorted((tuple(r) for r in codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error").collect()), key=repr)
    kept = [(i, label, [math.floor(4096 * float(np.float32(v))) for v in e] + [0] * (64 - len(e))) for i, e, label in data if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    want = plain_codes(kept)
    assert got == [r[:4] for r in want] and codes.digest(books) == want[0][4]
    few, books = codes.compress(table.filter("vec_id < 4"))
    assert books.shape[1] == 6 and few.agg({"error": "sum"}).first()[0] == 0
    none, _ = codes.compress(table.filter("false"))
    assert codes.with_label_errors(none).collect() == []
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e6] * 64, 1)], "vec_id long, embedding array<double>, label int"))


def distance(p, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(p, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def fewest(notice, text):
    """Fewest errors of any run of whole words, if no more than allowed."""
    words, best = text.split(), None
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            s = " ".join(words[a:b])
            if abs(len(s) - len(notice.text)) <= notice.errors:
                d = distance(notice.text, s)
                best = d if d <= notice.errors and (best is None or d < best) else best
    return best


def test_notices_with_errors_against_edit_distance():
    tool, rng = licenses.Scanner(licenses.PHRASES, licenses.NOTICES), random.Random(3)
    fuzzy = [i for i, n in enumerate(tool.notices) if not n.exact]
    hits = 0
    for _ in range(120):
        n = tool.notices[rng.choice(fuzzy)]
        w = list(n.text)
        for _ in range(rng.randrange(n.errors + 3)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "é", " ", "日"])
        text = " ".join(("words x" + "".join(w) + rng.choice([" more", "q more"])).split() if rng.random() < 0.3 else ("words " + "".join(w) + " more").split())
        want = {i: d for i in fuzzy if (d := fewest(tool.notices[i], text)) is not None}
        got = {}
        for i, a, b, e in tool.spans(text.encode()):
            if i in fuzzy:
                got[i] = min(e, got.get(i, e))
                assert distance(tool.notices[i].text, text.encode()[a:b].decode()) <= e
        assert got == want, text
        hits += len(want)
    assert hits > 40


def test_scan_of_documents(spark):
    texts = [
        (0, "Released under the MIT License."), (1, "Relesed under the MIT-Licence!"), (2, None), (3, ""), (4, "a mit licenses b permit license"),
        (5, "GNU General Public License; general\npublic  license MIT license mit License"), (6, "Licensed under CC BY-NC 4.0."), (7, "no notice here, general public interest"),
        (8, "É" * 500 + " the Apache LICENSE " + "z " * 20000 + "apache license"), (None, "MIT license"), (0, "Released under the MIT License."), (9, "日本 MIT license 日本"), (10, "mit" + chr(0x3000) + "license"),
    ]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    got = licenses.labelled(licenses.scan(docs)).collect()
    want = []
    for i, t in texts:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        found = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        want.append((i, len(words), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[1][0] == "mit" and 0 < labels[1][1] < 1 and labels[6] == ("cc", 1.0) and labels[7] == ("", 0.0) and labels[0] == ("mit", 1.0) and labels[2] == ("", 0.0)
    span = [m for r in licenses.scan(docs.filter("doc_id = 1")).collect() for m in r.matches]
    assert [(m.label, m.exact, m.first_word, m.words, m.text, m.edits > 0) for m in span] == [("mit", False, 0, 5, "relesed under the mit licence", True)]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_strings_of_added_tokens_are_encoded_as_the_library_does(spark):
    """Texts with the end-of-text mark, whole, cut and doubled, in shards and in packed pieces: the library's own ids."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokens.tokenizer_path())
    mark = "<|endoftext|>"
    texts = ["hello <|endoftext|> world", mark, mark * 3, f"a{mark}b", "<|endoftext| >", f"x\n{mark}\n\ny {mark} z", f"日本 {mark}  ü", "plain words", None, mark[:-1] + " " + mark]
    docs = spark.createDataFrame(rows(list(enumerate(texts))), SCHEMA).repartition(2)
    ids = {i: tool.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert 50256 in ids[0] and [b for b in tokens.encoder(tokens.tokenizer_path()).encode(texts)] == [np.array(ids[i], "<u2").tobytes() for i in range(len(texts))]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(*tokens.write_tokens(docs, tokens.tokenizer_path())).collect()}
    assert got == {i: (len(x) + 1, crc([*x, 0])) for i, x in ids.items()}
    whole = {r.doc_id: (r.length, r.ids_crc32) for r in packing.digest(packing.pack(docs, tokens.tokenizer_path())).collect() if r.start == 0 and r.length == r.doc_tokens}
    assert whole and all(v == (len(ids[i]) + 1, crc([*ids[i], 1])) for i, v in whole.items())
