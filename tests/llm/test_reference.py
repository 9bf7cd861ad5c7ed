"""Operators without SQL against plainly written versions of their rules: mixtures, bags, compression, packing, the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from test_operators import SCHEMA, brute_substrings, encode, fixture, shingles, words

from assaygrid.llm import common, langid, mixing, packing, quality, tokens, topk, toxicity

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def docs(spark):
    """The fixture, a huge text, one huge word, an id of several texts, null ids, and columns named like the results'."""
    rng = random.Random(8)
    long = " ".join(rng.choice(["thewher", "thatthin", "undich", "keitder"]) for _ in range(40_000))
    more = [(70, long), (71, "shan" * 30_000), (72, "the that wher"), (72, "und ich der"), (None, "the thin that"), (None, None), (None, "the thin that")]
    rows = fixture() + [(i, t, "aa" if i == 72 else None, "s1", len(t or ""), "k", "x", 1, "s", "y", 2, "z", 3) for i, t in more]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def plain_mixture(model, text, rounds=8, penalty=4.0):
    """The documented rule for one text, word by word."""
    low, k = text.lower().encode("utf-8", "replace"), len(model.langs)
    found = re.findall(rb"[a-z\x80-\xff]+", low)
    if not found or not re.search(r"[^\W\d_]", text):
        return None
    code = {b: i + 1 for i, b in enumerate([*range(97, 123), *range(128, 256)])}
    scores = []
    for w in found:
        c = [0, *(code[b] for b in w), 0]
        grams = [((c[i] * 163 + c[i + 1]) * 163 + c[i + 2]) & 0xFFFFFFFF for i in range(len(w))]
        at = [((g * 2654435761) & 0xFFFFFFFF) >> (32 - model.bits) for g in grams]
        scores.append([sum(float(model.logp[a, j]) for a in at) for j in range(k)])
    p = [[math.exp(max(s - max(row), -40)) for s in row] for row in scores]
    weight = [len(w) for w in found]

    def em(pi, n):
        for _ in range(n):
            new = [0.0] * k
            for row, w in zip(p, weight, strict=True):
                z = sum(a * b for a, b in zip(row, pi, strict=True))
                for j in range(k):
                    new[j] += w * row[j] * pi[j] / max(z, 1e-30)
            pi = [x / sum(weight) for x in new]
        return pi

    pi = em([1 / k] * k, rounds)
    order, best, size = sorted(range(k), key=lambda j: -pi[j]), -math.inf, 1
    for n in range(1, k + 1):
        own = {j: max(pi[j], 1e-6) for j in order[:n]}
        total = sum(own.values())
        fit = sum(math.log(max(sum(row[j] * v / total for j, v in own.items()), 1e-30)) for row in p) - penalty / 2 * (n - 1) * math.log(len(p) + 1)
        if fit > best + 1e-6:
            size = n
        best = max(best, fit)
    pi = [max(pi[j], 1e-6) if j in order[:size] else 0.0 for j in range(k)]
    return em([x / sum(pi) for x in pi], 3)


def test_mixtures_by_plain_em(docs):
    model = langid.fit(langid.learnable(docs))
    out = langid.predict(docs, model)
    assert {"__was_score", "lang_pred", "score", "mixture", "size"} <= set(out.columns)
    seen = 0
    for r in out.collect():
        if r.text and len(r.text) > 100_000:
            assert r.lang_pred in model.langs
            continue
        want = plain_mixture(model, r.text or "")
        if want is None:
            assert (r.lang_pred, r.score, r.mixture) == ("und", 0.0, {})
            continue
        seen += 1
        assert abs(r.score - min(1.0, max(want))) < 2e-3 and all(abs(r.mixture.get(x, 0.0) - v) < 2e-3 for x, v in zip(model.langs, want, strict=True)), (r.doc_id, r.mixture, want)
    assert seen > 60


def test_samples_stay_bounded_where_an_id_is_hot(spark):
    df = spark.createDataFrame([(None, f"text {i}", "aa") for i in range(900)] + [(i, "other", "bb") for i in range(50)], "doc_id long, text string, lang string")
    n = {r[0]: r[1] for r in common.bounded_sample(df, "lang", 100, df.doc_id, 1).groupBy("lang").count().collect()}
    assert n.get("aa", 0) <= 200 and n["bb"] == 50
    assert langid.fit(df, docs_per_lang=20).langs == ["aa", "bb"]


def test_bags_by_plain_noisy_or(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 > 0)) for i in range(60)] + [(5, None, None), (None, 1, 0), (7, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    model.weights.update({toxicity.features("und")[0]: 3.0, toxicity.features("wher")[0]: 2.5, toxicity.features("the")[0]: -1.0})
    model.trained = True

    def plain(text):
        miss = 1.0
        low = (text or "").lower()
        bags = re.findall(r"[^.!?\n]+", low) if low.strip() else [*re.findall(r"[^.!?\n]+", low), *([""] if not re.findall(r"[^.!?\n]+", low) else [])]
        for s in bags:
            z = sum(model.weights.get(f, 0.0) for token in s.split() for f in toxicity.features(token)) + model.bias
            miss *= 1 - 1 / (1 + math.exp(-z))
        return 1 - miss

    out = toxicity.predict(docs, model)
    assert "__was_score" in out.columns
    for r in out.collect():
        assert abs(r.score - plain(r.text)) < 1e-6, (r.doc_id, r.score, plain(r.text))
        assert all(r.text.lower()[s.start : s.end] for s in r.offending)
    assert toxicity.predict(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.predict(docs, toxicity.fit(docs.limit(0), labels.limit(0))).collect()} == {0.0}


def test_gradient_raises_the_likelihood():
    """Training through the noisy-or reaches at least the likelihood of a plain search over one weight and the bias."""
    bags = [[np.array([], np.int64)] * 3 + [np.array([1] if i < 30 else [], np.int64)] for i in range(120)]
    y = np.array([1] * 30 + [0] * 90)

    def likelihood(w, b):
        total = 0.0
        for bag, t in zip(bags, y.tolist(), strict=True):
            p = 1 - math.prod(1 - 1 / (1 + math.exp(-(b + w * len(s)))) for s in bag)
            total += (t * math.log(max(p, 1e-12)) + (1 - t) * math.log(max(1 - p, 1e-12))) * (2.0 if t else 2 / 3)
        return total

    model = toxicity.train(bags, y)
    assert likelihood(model.weights[1], model.bias) > max(likelihood(w, b) for w in range(0, 7) for b in range(-6, 0)) - 3


def test_quality_by_plain_compression(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(70)], "doc_id long, quality int")
    model = quality.fit(docs, labels, chunk=256)
    assert model.good and model.bad and model.values == sorted(model.values)
    out = quality.predict(docs, model)
    assert {"__was_score", "diff", "score"} <= set(out.columns)
    for r in out.collect():
        raw, sizes = (r.text or "").encode("utf-8", "replace"), []
        for d in (model.bad, model.good):
            tool = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append(sum(len(tool.compress(raw[i : i + 256])) for i in range(0, len(raw), 256)))
        x = (sizes[0] - sizes[1]) / max(1, len(raw))
        i = next((i for i, knot in enumerate(model.knots) if knot >= x), len(model.knots))
        if i in (0, len(model.knots)):
            want = model.values[min(i, len(model.knots) - 1)]
        else:
            a, b = model.knots[i - 1], model.knots[i]
            want = model.values[i - 1] + (x - a) / (b - a) * (model.values[i] - model.values[i - 1])
        assert abs(r.diff - x) < 1e-12 and abs(r.score - want) < 1e-9
    assert quality.predict(docs.limit(0), model).count() == 0
    assert {r.score for r in quality.predict(docs, quality.fit(docs.limit(0), labels.limit(0))).collect()} == {0.5}


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(1)
    x, y = np.arange(12.0), rng.integers(0, 2, 12)
    knots, values = quality.isotonic(x, y, least=1)
    # the isotonic fit at i is the max over starts of the min over ends of the means between them
    fit = [max(min(y[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert len(knots) == len(set(fit)) and [sum(f == v for f in fit) for v in sorted(set(fit))] == [round((sum(f == v for f in fit))) for v in sorted(set(fit))]
    assert all(a < b for a, b in zip(values, values[1:], strict=False))


def round_robin(queues, shares, window, length):
    """Pieces (queue, document, start, length, place) by playing the windows one after the other."""
    totals = [sum(n for _, n in q) for q in queues]
    done, out, place = [Fraction(0)] * len(queues), [], 0
    sent, at = [0] * len(queues), [(0, 0)] * len(queues)
    while sum(sent) < sum(totals):
        left = Fraction(1)  # of this window
        while left and any(d < t for d, t in zip(done, totals, strict=True)):
            live = [i for i in range(len(queues)) if done[i] < totals[i]]
            rate = {i: window * shares[i] / sum(shares[j] for j in live) for i in live}
            step = min([left, *((totals[i] - done[i]) / rate[i] for i in live)])
            for i in live:
                done[i] += rate[i] * step
            left -= step
        for i, q in enumerate(queues):
            n = math.floor(done[i]) - sent[i]
            sent[i] += n
            while n:
                d, start = at[i]
                k = min(n, q[d][1] - start, length - place % length)
                out.append((i, q[d][0], start, k, place))
                n, place = n - k, place + k
                at[i] = (d, start + k) if start + k < q[d][1] else (d + 1, 0)
    return out


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 1, "s2": 2, None: 1}])
def test_packing_by_playing_the_rounds(spark, weights):
    rows = sorted({(r[0], r[1] or "", r[3]) for r in fixture()}, key=lambda r: (r[0], r[1]))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    queues = [[(r[0], len(encode(r[1], 1))) for r in rows if r[2] == s] for s in order]
    shares = [Fraction(weights[s]) if weights else Fraction(sum(n for _, n in q)) for s, q in zip(order, queues, strict=True)]
    want = round_robin(queues, shares, 256, 64)
    got = packing.pack(df, tokens.tokenizer_path(), length=64, window=256, weights=weights).collect()
    assert sorted((order.index(p.source), p.doc_id, p.start, p.length, p.sequence_id * 64 + p.offset) for p in got) == sorted(want)
    if weights:  # while all queues last, every window has the target shares to within an id
        for w in range(4):
            seen = collections.Counter()
            for i, _, _, k, place in want:
                seen[i] += k if w * 256 <= place < (w + 1) * 256 else 0
            assert all(abs(seen[i] - 256 * s / sum(shares)) <= 65 for i, s in enumerate(shares) if sum(n for _, n in queues[i]) > 1300)


def test_token_order_of_repeated_and_null_ids(docs):
    rows = docs.select("doc_id", "text").collect()
    shards, dictionary = tokens.write_tokens(docs, tokens.tokenizer_path(), shard_ids=700)
    got = sorted(tokens.read_tokens(shards, dictionary).collect(), key=lambda r: r.start)
    ids = collections.Counter((r.doc_id, len(x := encode(r.text, 0)), zlib.crc32(x.tobytes())) for r in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ids
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0


def test_top_k_of_uneven_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=rng.choice([3, 64, 200])) * rng.choice([0.1, 1, 9])]) for i in range(130)] + [(200, []), (7, [1.0] * 64), (None, [1.0]), (20, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None]
    want = collections.Counter()
    by_query = collections.defaultdict(list)
    for q, v in ints:
        if q % 20 == 0:
            by_query[q].append(v)
    got = topk.top_k(df, k=5, block=3, bucket=16, seeds=4).collect()
    for q, own in by_query.items():
        if len(own) > 1:  # two vectors of one id are two query rows under one id
            continue
        best = sorted((-sum(a * b for a, b in zip(own[0], v, strict=False)), i) for i, v in ints if i != q)[:5]
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
        assert sorted((r.rank, r.score) for r in got if r.query_id == q) == [(k + 1, -s) for k, (s, _) in enumerate(best)]


def brute_stages(rows):
    """The five stages on rows (doc_id, text, source), written out; the last one's rows."""
    rows = sorted((r for r in rows if any(c.isalpha() for c in r[1] or "")), key=lambda r: (r[0], r[2] or ""))
    sets, label = [shingles(r[1], 5) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {c: min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label)}
    seen, kept = set(), []
    for r, c in zip(rows, label, strict=True):
        if r[0] == low[c] and (r[0], c) not in seen:
            seen.add((r[0], c))
            kept.append(r)
    count = collections.Counter()
    for r in kept:
        w = words(r[1])
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    cut = []
    for r in kept:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        cut.append((r[0], b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r[1], r[2]))
    order = sorted({r[2] for r in cut}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(words(r[1])) for r in cut if r[2] == s) for s in order}
    given = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(order)}
    target, full, rest = {}, set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        share = {s: rest * given[s] / sum(given[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            full.add(s)
            target[s] = Fraction(2 * sizes[s])
            rest -= target[s]
    mixed = []
    for s in order:
        own = sorted((hashlib.md5(f"{mixing.SEED}|{r[0]}".encode()).hexdigest(), len(words(r[1])), r) for r in cut if r[2] == s)
        whole = 2 if s in full else int(target[s] // sizes[s])
        part, through = target[s] - whole * sizes[s], 0
        for _, n, r in own:
            through += n
            extra = 0 < part and through - Fraction(n, 2) <= part
            mixed += [r] * (whole + extra)
    mixed.sort(key=lambda r: (r[0], r[1]))
    order = sorted({r[2] for r in mixed}, key=lambda s: (s is None, s or ""))
    ids = [[encode(r[1], 1) for r in mixed if r[2] == s] for s in order]
    names = [[r[0] for r in mixed if r[2] == s] for s in order]
    queues = [[(k, len(x)) for k, x in enumerate(q)] for q in ids]
    out = []
    for q, k, start, n, place in round_robin(queues, [Fraction(sum(n for _, n in x)) for x in queues], 8 * 2048, 2048):
        x = ids[q][k]
        out.append((names[q][k], start, n, zlib.crc32(x[start : start + n].tobytes()), len(x), place // 2048, place % 2048))
    return sorted(out)


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(fixture(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_stages([(r[0], r[1], r[3]) for r in fixture()])
    for _ in range(2):
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in out.collect()) == want
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_language_stage_without_labels_keeps_texts(spark, docs):
    bare = docs.withColumn("lang", docs.lang.cast("string").substr(1, 0)).replace("", None, ["lang"])
    assert langid.stage(spark, bare, "").count() == docs.count()


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Fake)


def test_brute_substring_version_sees_repeats():
    assert sum(x[2] for x in brute_substrings(fixture())) > 0


def test_huge_texts_null_and_repeated_ids(docs):
    """Substrings, near duplicates and mixing on the same odd rows, against the plain versions."""
    from assaygrid.llm import minhash, substring

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove(docs).collect()]
    assert sorted(got, key=repr) == brute_substrings(rows)
    sets, label = [shingles(r[1], 4) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = {c: [rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None] for c in set(label)}
    want = sorted(((rows[i][0], len(sets[i]), min(ids[label[i]], default=None)) for i in range(len(rows))), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size=4).collect()), key=repr) == want
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(rows) and all(r["size"] == len(words(r.text)) and r.taken <= 2 * r["size"] for r in taken)


def test_packing_stage_gives_the_pieces(spark, docs):
    same = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert same(packing.stage(spark, docs, "")) == same(packing.digest(packing.pack(docs, tokens.tokenizer_path())))


def test_embeddings_of_uneven_lengths(spark):
    from assaygrid.llm import hnsw

    rng = np.random.default_rng(3)
    base = [rng.normal(size=n) for n in (3, 8, 200, 64)]
    rows = [(10 * k + i, [float(x) for x in v * (1 + i)] + [0.0] * i) for k, v in enumerate(base) for i in range(3)] + [(90, []), (91, None), (5, [1.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw.near_duplicates(df, min_shards=2, width=4).collect())
    want = sorted([(10 * k + i, 2, 10 * k) for k in range(4) for i in range(3)] + [(90, 0, 90), (91, 0, 91), (5, 1, 5), (5, 1, 5)])
    assert got == want


def test_learning_of_toxic_features_by_plain_counts(spark, monkeypatch):
    """Which features are chosen and which bags are trained on, counted plainly from all labelled texts, repeated ids included."""
    rng = random.Random(21)
    common_words, bad = ["river", "stone", "Garden", "über", "x1y", "lantern", "don't"], ["vilest", "vilely", "rotten"]
    texts = [(i, ". ".join(" ".join(rng.choices(common_words, k=6) + ([rng.choice(bad)] if i % 4 == 0 and rng.random() < 0.8 else [])) for _ in range(3))) for i in range(300)]
    texts += [(4, "vilest of all"), (5, ""), (301, None), (302, "y" * 40000 + " vilest")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(303) if i % 7] + [(8, None)], "doc_id long, toxic int")
    given = {}
    select, train = toxicity.select, toxicity.train
    monkeypatch.setattr(toxicity, "select", lambda *a: given.setdefault("chosen", select(*a)))
    monkeypatch.setattr(toxicity, "train", lambda bags, y, **how: given.update(bags=bags, y=y) or train(bags, y, **how))
    model = toxicity.fit(docs, labels)

    def marks(token):
        for word in re.findall(r"[^\W\d_]+", token):
            yield zlib.crc32(b"w" + word.encode()) % (1 << 20)
            yield from (zlib.crc32(str(n).encode() + word[:n].encode()) % (1 << 20) for n in range(3, 7) if len(word) >= n)

    rows = [(t.lower(), int(i % 4 == 0)) for i, t in texts if t is not None and len(t.encode()) <= 1 << 15 and i % 7 and i < 303]
    seen, n = {0: collections.Counter(), 1: collections.Counter()}, collections.Counter(y for _, y in rows)
    for t, y in rows:
        seen[y].update({m for token in t.split() for m in marks(token)})
    want = set()
    for m, k in seen[1].items():
        a, b, both = k / n[1], seen[0][m] / n[0], (k + seen[0][m]) / (n[0] + n[1])
        if (a - b) / math.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-12) > 3 and k >= 2 and a > 4 * b:
            want.add(m)
    assert given["chosen"] == want and {next(marks(w)) for w in bad} <= want
    bags = sorted((y, [[m for token in s.split() for m in marks(token) if m in want] for s in re.findall(r"[^.!?\n]+", t)] or [[]]) for t, y in rows)
    assert [(int(y), [s.tolist() for s in b]) for y, b in zip(given["y"], given["bags"], strict=True)] == bags
    assert set(model.weights) <= want and toxicity.predict(docs.filter("doc_id = 4"), model).agg({"score": "min"}).first()[0] > 0.5
