import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import empty
from tidemark.llm import language, quality, sampling, toxicity

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out(spark):
    got = spark.range(200).select("id", sampling.held_out("id").alias("h")).collect()
    assert all(r.h == held(r.id) for r in got)


def test_platt():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, 20000)
    y = (rng.random(20000) < sampling.sigmoid(2 * x - 1)).astype(float)
    a, b = sampling.platt(x, y)
    assert abs(a - 2) < 0.2 and abs(b + 1) < 0.2
    assert np.isfinite(sampling.platt(np.zeros(5), np.ones(5))).all()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 -- !", None, "s", 0), (10**6 + 3, "the and " * 90000, None, "s", 0)], docs.schema)
    df = docs.union(odd)
    model = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [i for i in truth if held(i)]
    assert np.mean([got[i].lang_pred == truth[i] for i in out]) > 0.97
    assert all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i in got)
    assert all(got[10**6 + k].lang_pred == "und" and got[10**6 + k].score == 0 and got[10**6 + k].rejected for k in range(3))
    assert got[10**6 + 3].lang_pred == "en" and len(got) == df.count()
    assert language.identify(empty(spark), language.fit(empty(spark))).count() == 0
    assert language.identify(odd, language.Model([], np.zeros((1, 1)), np.zeros(0))).first().lang_pred == "und"


def toxic_corpus(spark, n=900):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 150))]
        if bad := i % 3 == 0:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["grumblewort", "zanklefish", "grumbleworts"])
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (n + 2, " ".join(vocabulary * 30) + " grumblewort zanklefish grumbleworts", None, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS)


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [i for i in truth if held(i)]
    assert np.mean([got[i].predicted == truth[i] for i in out]) > 0.95
    assert all(g.held_out == held(i) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for i, g in got.items())
    assert got[900].score == 0 and got[901].score == 0 and got[902].predicted == 1  # in the last of many windows
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if not g.predicted}
    tie = got[0].score  # a score equal to the threshold is toxic
    assert all(r.predicted == 1 for r in toxicity.score_texts(docs.where("doc_id = 0"), model, threshold=tie).collect())
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_texts(docs, nothing).collect()} == {0.0}
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_network_gradients():
    """Analytic gradients against differences."""
    rng = np.random.default_rng(3)
    net = toxicity.Network(5)
    net.w["attend"] = rng.normal(0, 0.5, 2 * toxicity.HIDDEN).astype(np.float32)
    ids = rng.integers(0, 6, (4, 7)).astype(np.int32)
    ids[:, 0] = 1
    y, weights, x = np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32), rng.normal(0, 1, (5, toxicity.INPUT)).astype(np.float32)

    def loss():
        logit = net.pool(ids, net.states(ids, net.padded(net.project(x))))[2].astype(np.float64)
        return (np.logaddexp(0, logit) - y * logit).mean()

    g, _ = net.gradients(ids, y, weights, net.padded(net.project(x)))
    for name in ("uf", "ub", "attend", "out"):
        flat, grad = net.w[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in rng.choice(len(flat), 6, replace=False):
            was = flat[k]
            flat[k] = was + 1e-2
            up = loss()
            flat[k] = was - 1e-2
            down = loss()
            flat[k] = was
            assert abs((up - down) / 2e-2 - grad[k]) < 2e-3, name


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    model = quality.fit(docs, labels)
    scored = quality.score_documents(docs.union(odd), model)
    got = {r.doc_id: r for r in scored.collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [i for i in truth if held(i)]
    assert np.mean([got[i].kept == (truth[i] == 1) for i in out]) > 0.93
    assert len(got) == docs.count() + 2 and all(0 <= g.score <= 1 for g in got.values())
    bare = quality.score_documents(docs.select("doc_id", "text"), quality.fit(docs, labels.limit(0)))
    assert {r.score for r in bare.collect()} == {1.0}
    assert quality.score_documents(docs.limit(0), model).count() == 0


def quality_fixture(spark, n=40):
    long = " ".join(f"w{k}" for k in range(3000)) + "\nx | y\nx | y"
    rows = [(i, f"{long} {i}" if i % 2 else f"short {i}", "en", "s", 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "co_train", lambda labelled, pool, prior: seen.update(labelled=labelled, pool=pool) or quality.Model(prior))
    docs = quality_fixture(spark)
    quality.fit(docs, spark.createDataFrame([(i, i // 2 % 2, 0) for i in range(20)], LABELS))
    texts = {r.doc_id: r.text for r in docs.collect()}
    text, meta = quality.View(7), quality.View(1)
    text.d[0] = 1.0  # longer texts score higher
    handed = seen["pool"].confident(text, meta)
    assert handed[1] == {}  # a view that tells nothing apart hands nothing over
    free = [i for i in range(20, 40) if not held(i)]
    for label, rows in handed[0].items():
        assert set(rows["doc_id"]) == {i for i in free if i % 2 == label}
    for rows in (seen["labelled"], *handed[0].values()):
        flat, dense, _, _ = quality.features(rows)
        assert len(rows)
        for k, i in enumerate(rows["doc_id"]):
            words = texts[i].split()
            assert np.allclose(dense[k], quality.text_ratios(texts[i], words))
            w = np.random.default_rng(1).normal(size=quality.BUCKETS)
            assert np.isclose(w[flat[k][0]] @ flat[k][1], np.mean([w[b] for x in words for b in quality.word_features(x)]))


def test_quality_scores_are_the_plain_sums(spark):
    """The scorer, which remembers words, against the definition of each view."""
    rng = np.random.default_rng(7)
    text, meta = quality.View(7), quality.View(1)
    text.w, text.d, meta.w, meta.d = rng.normal(size=quality.BUCKETS), rng.normal(size=7), rng.normal(size=quality.BUCKETS), rng.normal(size=1)
    model = quality.Model(0.4, text, meta, ((0.7, 0.1), (1.2, -0.3)), (0.8, 0.5, 0.05))
    docs = quality_fixture(spark, 8).union(spark.createDataFrame([(None, None, None, None, None), (3, "", "en", None, 5)], quality_fixture(spark, 1).schema))
    for r in quality.score_documents(docs, model).join(docs.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).where("doc_id <> 3").collect():
        words = (r.text or "").split()
        flat = [b for w in words for b in quality.word_features(w)]
        t = (np.mean(text.w[flat]) if flat else 0.0) + quality.text_ratios(r.text or "", words) @ text.d
        m = np.mean(meta.w[list(quality.metadata_features(r.source, r.lang, r.n_chars))]) + meta.d[0]
        want = [x[0] for x in model.combined(np.array([t]), np.array([m]))]
        assert np.allclose([r.text_score, r.metadata_score, r.score], want) and r.kept == (r.score >= 0.5)


def plain_gru(net, word_ids, inputs):
    """Logit of one window, a word at a time."""
    h, states = toxicity.HIDDEN, {}
    for side, order in (("f", range(len(word_ids))), ("b", range(len(word_ids) - 1, -1, -1))):
        state = np.zeros(h)
        for t in order:
            if word_ids[t]:
                x = inputs[word_ids[t] - 1] @ net.w["x" + side] + net.w["c" + side]
                u = state @ net.w["u" + side]
                z, r = sampling.sigmoid(x[:h] + u[:h]), sampling.sigmoid(x[h : 2 * h] + u[h : 2 * h])
                n = np.tanh(x[2 * h :] + r * u[2 * h :])
                state = (1 - z) * n + z * state
            states[side, t] = state
    own = [t for t in range(len(word_ids)) if word_ids[t]]
    both = np.array([np.r_[states["f", t], states["b", t]] for t in own])
    a = np.exp(both @ net.w["attend"])
    return (a / a.sum()) @ both @ net.w["out"] + net.w["bias"][0]


def test_toxicity_scores_are_a_plain_networks(spark, monkeypatch):
    """Windows, remembered words and long words against one word and one window at a time."""
    monkeypatch.setattr(toxicity, "CHARS_AT_ONCE", 40)
    rng = np.random.default_rng(9)
    net = toxicity.Network(2)
    net.w["word"] = rng.normal(0, 0.3, net.w["word"].shape).astype(np.float32)
    net.w["attend"] = rng.normal(0, 0.5, 2 * toxicity.HIDDEN).astype(np.float32)
    model = toxicity.Model(net, 1.3, -0.2, 0.1)
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(n)) for n in (1, 5, 31, 32, 33, 56, 57, 200)]
    texts += ["z" * 39 + " y", "ab" * 100 + " word " + "q" * 41, "", None, "..."]
    got = model.scorer()(texts)
    for text, score in zip(texts, got, strict=True):
        words = toxicity.find_words((text or "").lower())
        if not words:
            assert score == 0
            continue
        inputs = []
        for w in words:
            marked = f"<{w}>"
            grams = [g for n in toxicity.NGRAMS for g in [marked[i : i + n] for i in range(len(marked) - n + 1)]]
            ids = []
            for g in grams:
                h = len(g)
                for c in g:
                    h = (h * 0x100000001B3 % 2**64) ^ ord(c)
                ids.append((h * 0x9E3779B97F4A7C15 % 2**64) >> 49)
            inputs.append(net.w["word"][1 + zlib.crc32(w.encode()) % (toxicity.WORD_BUCKETS - 1)] + net.w["char"][ids].mean(axis=0))
        n, best = len(words), -np.inf
        for start in range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            best = max(best, plain_gru(net, [k + 1 if k < n else 0 for k in range(start, start + toxicity.WINDOW)], inputs))
        assert abs(score - sampling.sigmoid(1.3 * best - 0.2)) < 1e-4, text


def test_language_scores_are_plain_averages(monkeypatch):
    """Averages over all n-grams, of texts in pieces too, against one n-gram at a time."""
    monkeypatch.setattr(language, "PIECE", 16)
    rng = np.random.default_rng(6)
    table = np.zeros(((1 << language.BITS) + 1, 4))
    table[:-1, :3], table[:-1, 3] = rng.normal(size=(1 << language.BITS, 3)), 1
    model = language.Model(["a", "b", "c"], table, rng.normal(size=3))
    letters = language.Letters()
    for text in ("x", "Ein Wort, zwei", "the quick brown fox jumps over the lazy dog " * 3, "日本 語é"):
        codes = letters.of(f" {text} ")
        rows = []
        for n in language.NGRAMS:
            for i in range(len(codes) - n + 1):
                g = codes[i : i + n]
                if (g[1:-1] > 0).all() and g.any() and (n > 2 or g.any()):
                    rows.append(table[language.ngram_buckets(g, n)[0], :3])
        want = np.mean(rows, axis=0) + model.bias
        got, _ = model.logits([text], letters)
        assert np.allclose(got[0], want), text


def test_rare_languages_and_repeated_ids_are_learned_once(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(["uno", "dos", "tres"]) for _ in range(9)), "es") for i in range(3000)]
    docs += [(10**6 + i, " ".join(rnd.choice(["yksi", "kaksi", "kolme"]) for _ in range(9)), "fi") for i in range(12)]
    docs += [(5, "uno dos", "es")] * 2000
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    wanted = df.select("doc_id", F.col("lang").alias("label"))
    rows = sampling.stratified_sample(df, wanted, 400, 4, 250)
    assert rows["doc_id"].is_unique and 150 <= (rows["label"] == "es").sum() <= 200
    assert set(rows["doc_id"][rows["label"] == "fi"]) == {10**6 + i for i in range(12) if not held(10**6 + i)}
