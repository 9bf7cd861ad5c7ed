"""Each corpus operator against a brute-force version on a fixture with nulls, empty texts, copies and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from assaygrid.llm import common, fmindex, hnsw, langid, minhash, mixing, packing, quality, substring, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, size int, s string, kept string, n int, node string, part int"


def fixture():
    rng = random.Random(5)
    vocab = {"aa": ["the", "of", "thin", "that", "wher", "shan"], "bb": ["und", "ich", "keit", "der", "lich", "zu"]}
    word = lambda lang: "".join(rng.choice(vocab[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda lang, n: " ".join(word(lang) + rng.choice(["", "", ".", ","]) for _ in range(n))
    shared = text("aa", 50)
    rows, long = [], text("bb", 3000)
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        t = text(lang, rng.choice([1, 3, 40, 90, 200]))
        if i % 7 == 0:
            t += " " + shared + "\n" + text(lang, 5)
        rows.append((i, t, lang, f"s{i % 3}"))
    rows += [(60, None, None, None), (61, "", "aa", "s0"), (62, "  \n ", "bb", None), (63, "123 456", "aa", "s1"), (64, long, "bb", "s0"), (65, rows[3][1], "aa", "s1"), (66, rows[3][1], "aa", "s2")]
    rows += [(67, rows[8][1] + " extra", "bb", "s1"), (68, rows[9][1].replace("the", "The", 1), None, "s0"), (5, rows[5][1], "aa", "s0"), (69, "Ünïcode — 日本 don't  two  spaces ", "aa", "s0")]
    return [(*r, len(r[1] or ""), "k", "x", 1, "s", "y", 2, "z", 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_mixture_of_six_languages():
    """Six languages with letters of their own, in equal parts, are all in the mixture; of one language, only it is."""
    words = ["aba", "cdc", "efe", "ghg", "iji", "klk"]
    counts = np.zeros((1 << 17, 6))
    for k, w in enumerate(words):
        counts[:, k] += np.bincount(langid.trigrams(np.frombuffer(w.encode(), np.uint8), 17)[1], minlength=1 << 17)
    model = langid.MixtureModel(words, np.log((100 * counts + 0.02) / (100 * counts + 0.02).sum(0)).astype(np.float32))
    mixed, plain = langid.mixtures(model, [" ".join(words * 40), " ".join(words[:1] * 40)])
    assert np.allclose(mixed, 1 / 6, atol=0.01) and np.flatnonzero(plain).tolist() == [0]


def test_language(docs, none):
    model = langid.fit(langid.learnable(docs))
    got = {(r.doc_id, r.text): r for r in langid.predict(docs, model).collect()}
    for r in fixture():
        p = got[r[0], r[1]]
        assert 0 <= p.score <= 1
        if not any(c.isalpha() for c in r[1] or ""):
            assert (p.lang_pred, p.score, p.mixture) == ("und", 0.0, {})
        elif len(words(r[1])) > 30:
            assert p.lang_pred == (r[2] or "bb" if r[0] == 68 else r[2]) or r[0] in (0, 7, 14, 21, 28, 35, 42, 49, 56, 68)
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
    kept = langid.stage(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4


def test_mixture_of_two_languages(docs):
    model = langid.fit(docs)
    rows = fixture()
    both = rows[64][1] + " " + " ".join(r[1] for r in rows[1:60:2] if r[0] % 7)
    one, two = (dict(zip(model.langs, x, strict=True)) for x in langid.mixtures(model, [rows[64][1], both]))
    assert one["bb"] > 0.95 and 0.2 < two["aa"] < 0.8


def brute_substrings(rows, n=35):
    seen = collections.Counter()
    for r in rows:
        w = words(r[1])
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4000, 3])
def test_substrings(docs, none, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove(docs).collect()]
    want = brute_substrings(fixture())
    assert sorted(got, key=repr) == want and sum(x[2] for x in want) > 300
    assert substring.remove(none).count() == 0
    out = substring.stage(docs.sparkSession, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()


def test_fm_index():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(1, 4, rng.integers(4, 12)) for _ in range(40)]
    index = fmindex.FMIndex(seqs)
    for _ in range(200):
        s = seqs[rng.integers(40)]
        a = rng.integers(len(s))
        p = s[a : a + rng.integers(1, 6)]
        lo, hi = index.first(p[-1:])
        for c in p[-2::-1]:
            lo, hi = index.step(np.array([c]), lo, hi)
        count = sum(tuple(x[i : i + len(p)]) == tuple(p) for x in seqs for i in range(len(x)))
        assert max(0, int((hi - lo)[0])) == count


def encode(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_shards(docs, none):
    shards, dictionary = tokens.write_tokens(docs, tokens.tokenizer_path(), shard_ids=500)
    assert shards.count() > 5
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(shards, dictionary).collect()), key=lambda x: x[1])
    start, want = 0, []
    for r in sorted(fixture(), key=lambda r: (r[0], r[1] or "")):
        ids = encode(r[1], 0)
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    first = shards.orderBy("part", "shard").first().content
    assert (tokens.read_document(first, 1, dictionary) == encode(fixture()[1][1], 0)).all()
    with pytest.raises(ValueError):
        tokens.read_document(first, 0, b"other")
    empty, d = tokens.write_tokens(none, tokens.tokenizer_path())
    assert tokens.read_tokens(empty, d).count() == 0


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 1, "s2": 1, None: 1}])
def test_packing(docs, none, weights):
    got = packing.pack(docs, tokens.tokenizer_path(), length=64, window=256, weights=weights).collect()
    by = collections.defaultdict(list)
    for p in got:
        by[p.doc_id, p.source].append(p)
    ids = collections.defaultdict(list)
    for r in fixture():
        ids[r[0], r[3]].append(encode(r[1], 1))
    for k, pieces in by.items():
        whole = b"".join(p.ids for p in sorted(pieces, key=lambda p: p.start))
        assert whole == ids[k][0].tobytes() and len(ids[k]) == 1
    assert by.keys() == ids.keys()
    place = sorted((p.sequence_id * 64 + p.offset, p.length) for p in got)
    assert all(a + n == b for (a, n), (b, _) in zip(place, place[1:], strict=False)) and place[0][0] == 0
    full = packing.sequences(packing.pack(docs, tokens.tokenizer_path(), length=64, window=256), length=64).collect()
    assert all(len(r.ids) == 256 for r in full[:-1]) and sum(r.n_ids for r in full) == sum(len(x[0]) for x in ids.values())
    assert packing.pack(none, tokens.tokenizer_path()).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    total = sum(len(words(r[1])) for r in fixture())
    sizes = collections.Counter()
    for r in fixture():
        sizes[r[3]] += len(words(r[1]))
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-3 and all(targets[s] <= 2 * sizes[s] for s in sizes if s)
    for s in targets:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - targets[s]) <= max([r.size for r in got if r.source == s], default=0)
    assert all(r.taken <= 2 * r.size for r in got) and len(got) == len(fixture())
    assert mixing.mix(none).count() == 0
    out = mixing.stage(docs.sparkSession, docs, "")
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def shingles(t, n):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(t)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("leaf", [2048, 4])
def test_near_duplicates(docs, none, leaf):
    rows = fixture()
    sets = [shingles(r[1], 4) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {c: min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label)}
    want = sorted((rows[i][0], len(sets[i]), low[label[i]]) for i in range(len(rows)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size=4, leaf=leaf).collect())
    assert got == want
    assert minhash.near_duplicates(none).count() == 0
    out = minhash.stage(docs.sparkSession, docs, "")
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and len(kept) == len(set(kept)) and {60, 61, 62} <= set(kept) and not {65, 66} & set(kept)


@pytest.mark.parametrize("deal", [8, 1])
def test_large_nodes_lose_no_link(spark, deal, monkeypatch):
    """A group much larger than a node may be, with documents that hang on by one link, and others that share a passage with it."""
    monkeypatch.setattr(minhash, "DEAL", deal)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(100)]
    made = [base]
    for _ in range(399):
        t = list(base if rng.random() < 0.6 else rng.choice(made))
        for _ in range(rng.choice([1, 1, 2, 3])):
            t[rng.randrange(len(t))] = word()
        made.append(t)
    made += [base[: rng.randrange(20, 90)] + [word() for _ in range(rng.randrange(5, 80))] for _ in range(150)]
    texts = [" ".join(t) for t in made]
    names, sets = {}, [shingles(t, 4) for t in texts]
    has = np.zeros((len(sets), sum(map(len, sets))), np.float32)
    for i, x in enumerate(sets):
        has[i, [names.setdefault(g, len(names)) for g in x]] = 1
    shared, n = has @ has.T, has.sum(1)
    link = 100 * shared >= 80 * (n[:, None] + n[None, :] - shared)
    want, before = np.arange(len(texts)), None
    while before is None or (want != before).any():
        before, want = want, np.array([want[row].min() for row in link])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=4, leaf=16).collect()}
    assert got == dict(enumerate(want.tolist()))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def odd_vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 8))
    base[40:70] = base[0] + 0.02 * rng.normal(size=(30, 8))
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(base)]
    rows += [(150, rows[3][1], 0), (151, rows[3][1], 0), (160, None, 0), (161, [0.0] * 8, 0), (162, [float("nan")] + [0.0] * 7, 0), (163, [None] + [1.0] * 7, 0), (180, rows[0][1], None)]
    return rows


def test_top_k(spark):
    rows = odd_vectors()
    good = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(int)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 20 == 0:
            s = sorted(((-int(v @ c), i) for i, c in good if i != q))[:20]
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    for least in (0.85, 0.0):
        got = {tuple(r) for r in topk.top_k(vectors(spark, rows), bucket=16, seeds=8, coordinate_from=least).collect()}
        assert got == want
    assert topk.top_k(vectors(spark, [])).count() == 0


def test_embedding_near_duplicates(spark):
    rows = odd_vectors()
    good = {i: np.array(v, dtype=np.float64) / np.linalg.norm(v) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in good if j != i and good[i] @ good[j] >= 0.95} for i in good}
    comp = {i: i for i, _, _ in rows}
    for _ in range(10):
        comp = {i: min([comp[i], *(comp[j] for j in links.get(i, ()))]) for i in comp}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(vectors(spark, rows), min_shards=2, width=4).collect()}
    assert got == {i: (len(links.get(i, ())), comp[i], comp[i] == i) for i in comp}
    assert hnsw.near_duplicates(vectors(spark, [])).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    q = x[:200].astype(np.float32)
    truth = np.argsort(-(q @ g.base.T), axis=1)[:, :10]
    ids = g.near(q, 64)[0][:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth, ids, strict=True)]) > 0.9


def labelled(spark, bad):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["stone", "river", "green", "walk", "morning", "house", "slow"]) for _ in range(30))
    rows, labels = [], []
    for i in range(300):
        y = int(i % 3 == 0)
        rows.append((i, bad(plain(), rng) if y else plain() + ". " + plain()))
        labels.append((i, y))
    rows += [(300, None), (301, ""), (5, "repeated row")]
    labels += [(2, None), (900, 1), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int")


def test_toxicity(spark):
    docs, labels = labelled(spark, lambda t, r: t + ". you " + r.choice(["grubling", "grubber"]) + " go away. " + t)
    model = toxicity.fit(docs, labels.filter(common.id_crc() % 3 != 1), label="y")
    got = {(r.doc_id, r.text): r for r in toxicity.predict(docs, model).collect()}
    for (i, t), r in got.items():
        assert 0 <= r.score <= 1
        if i < 300 and t != "repeated row":
            assert (r.score >= 0.7) == (i % 3 == 0)
            assert all("grub" in t[s.start : s.end] for s in r.offending) and bool(r.offending) == (i % 3 == 0)
    assert got[300, None].score == got[301, ""].score < 0.7
    blank = toxicity.fit(docs, labels.filter("y = 0"), label="y")
    assert {r.score for r in toxicity.predict(docs, blank).collect()} == {0.0}


@pytest.mark.parametrize("n", [200, 300, 301, 6000])
def test_toxic_words_count_alike_at_every_size(n):
    """A word of 9 toxic documents alone is selected and learned beside a common one; chance words are not."""
    z = lambda k, c: toxicity.select(np.array([c]), np.array([k]), n, n) == {0}
    assert z(9, 0) and z(12, 0) and z(30, 5) and not z(8, 0) and not z(1, 0) and not z(9, 9)
    assert len(toxicity.select(np.zeros(5000, int), np.full(5000, 9), n, n)) == 5000
    bags = [[np.array([], np.int64), np.array([2 if i < 9 else 1])] for i in range(n)] + [[np.array([], np.int64)]] * n
    model = toxicity.train(bags, np.repeat([1, 0], n))
    score = lambda *w: 1 - np.prod([1 - toxicity.sigmoid(model.bias + sum(model.weights.get(x, 0) for x in s)) for s in w])
    assert score([], [2]) >= 0.7 and score([], [1]) >= 0.7 and score([], []) < 0.3


def test_quality(spark):
    docs, labels = labelled(spark, lambda t, r: " ".join(w.upper() + "!!" for w in t.split()))
    model = quality.fit(docs, labels.withColumn("y", 1 - labels.y).filter(common.id_crc() % 5 != 0), label="y")
    got = [r for r in quality.predict(docs, model).collect() if r.doc_id < 300 and r.text != "repeated row"]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 3 != 0) for r in got]) > 0.97
    few = quality.fit(docs, labels.filter("y = 1"), label="y")
    assert {r.score for r in quality.predict(docs, few).collect()} == {1.0}


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "substring_dedup", "mixing", "packing"]
    rows = out.collect()
    assert rows and not {60, 61, 62, 63, 65, 66} & {r.doc_id for r in rows}
