"""The fitted operators: classifier, language models, languages."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seagrid.llm import language_mix, lm_score, quality_net

from corpus import documents, made, nothing, odd

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def marked(spark):
    """Plain prose is good; shouting and symbol noise somewhere in it is not."""
    rng = random.Random(1)
    syllables = ["the", "on", "er", "an", "re", "ing", "ha", "tion", "st"]
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(8, 150))]
        good = i % 4 != 0
        if not good:
            at, n = rng.randrange(len(words)), 12
            words[at:at + n] = [w.upper() + "!!" if i % 8 else w + "###" for w in words[at:at + n] * 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return documents(spark, rows).cache(), spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="module")
def net(marked):
    docs, labels = marked
    return quality_net.fit(docs.where(quality_net.fold(F.col("doc_id"), 5) != 0), labels)


def test_classifier_is_right_on_held_out_documents(marked, net):
    docs, labels = marked
    rows = quality_net.scored(docs, net).where(quality_net.fold(F.col("doc_id"), 5) == 0).join(labels, "doc_id").collect()
    right = np.mean([(r._score >= quality_net.LEAST) == r.quality for r in rows])
    assert len(rows) > 50 and right > 0.9 and all(0 <= r._score <= 1 for r in rows)


def test_a_score_depends_on_the_whole_text_and_on_nothing_else(net):
    """Neighbours in a block do not matter, and noise at the end of a long text does."""
    halves = quality_net.tables(net)

    def scores(*texts):
        size = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        return quality_net.score_rows(net, halves, data, np.cumsum(size) - size, np.cumsum(size))

    texts = [b"", b"the", b"the ing tion " * 50, b"x" * 64, b"THE!! ON!! " * 9, b"the on " * 9000]
    together = scores(*texts)
    assert np.allclose(together, [scores(t)[0] for t in texts])
    long = b"the ing tion on an " * 500
    assert scores(long + b"THE!! ERING!! ONST!! " * 12)[0] < scores(long)[0]


def test_lookup_equals_convolution(net):
    """Scoring by pair tables gives what the training's matrix products give."""
    text = "the on ér ###".encode() * 20
    data = np.frombuffer(text, np.uint8)
    rows, hops = quality_net.padded(data, np.array([0]), np.array([len(data)]))
    padded = np.append(rows, [0, 0]).astype(int)
    windows = np.array([padded[k:k + 4] for k in range(0, len(rows), 2)])
    narrow = np.maximum(net.embed[windows].reshape(len(windows), -1) @ net.narrow + net.narrow_bias, 0)
    chunk = [narrow[k * 32:(k + 2) * 32].mean(0) for k in range(len(rows) // 64 - 1)]
    z = np.maximum(np.array(chunk) @ net.wide + net.wide_bias, 0).max(0) @ net.out + net.out_bias
    got = quality_net.score_rows(net, quality_net.tables(net), data, np.array([0]), np.array([len(data)]))
    assert np.allclose(got, 1 / (1 + np.exp(-z)), atol=1e-4)


def test_classifier_on_odd_rows(spark, net):
    got = quality_net.scored(odd(spark), net)
    assert got.count() == 16 and set(odd(spark).columns) < set(got.columns)
    assert quality_net.scored(odd(spark), net, least=0.0).count() == 16
    assert quality_net.scored(odd(spark), net, least=1.1).count() == 0
    assert quality_net.scored(nothing(spark), net).collect() == []
    none = spark.createDataFrame([], LABELS)
    assert quality_net.fit(odd(spark), none) is None
    odd_labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 0, 0), (99, 1, 1)], LABELS)
    assert quality_net.fit(odd(spark), odd_labels) is None
    assert {r._score for r in quality_net.scored(odd(spark), None).collect()} == {0.5}


def plain_model(c, scale, vocabulary):
    """A loss by history and word from counted pairs, with dictionaries."""
    word, history = Counter(), Counter()
    for (h, w), n in c.items():
        word[w] += n * scale
        history[h] += n * scale
    total = sum(word.values())

    def loss(h, w):
        lower = (word[w] + lm_score.BACK / vocabulary) / (total + lm_score.BACK)
        return -np.log((c[h, w] * scale + lm_score.BACK * lower) / (history[h] + lm_score.BACK))
    return loss


def plain_models(rows, wanted):
    """Pairs of every document, all words and one unknown, and both models, word by word."""
    pairs = {i: list(zip(["<s>", *t.split()], t.split())) for i, t in rows}
    target, back = Counter(), Counter()
    for i, p in pairs.items():
        back.update(p)
        if i in wanted:
            target.update(p)
    words = sorted({w for _, w in back}) + [None]
    scale = sum(target.values()) / sum(back.values())
    return pairs, words, plain_model(target, 1.0, len(words)), plain_model(back, scale, len(words))


def plain_losses(rows, wanted):
    pairs, _, *models = plain_models(rows, wanted)
    return {i: (len(p), *(sum(m(*x) for x in p) / max(1, len(p)) for m in models)) for i, p in pairs.items()}


def test_language_models_equal_plain_ones(spark):
    rows = made(n=40)
    wanted = {i for i, _ in rows if i % 2}
    docs = documents(spark, rows)
    target = spark.createDataFrame([(i,) for i in wanted] * 2 + [(None,)], "doc_id long")
    want = plain_losses(rows, wanted)
    got = {r.doc_id: r for r in lm_score.scored(docs, lm_score.fit(docs, target)).collect()}
    for i, (n, a, b) in want.items():
        assert got[i].n_tokens == n
        assert np.allclose([got[i].target_loss, got[i].background_loss, got[i].score], [a, b, b - a])


def test_language_models_know_every_word(spark, monkeypatch):
    """However few words are frequent and however the tokens are dealt out."""
    rows = made(n=80)
    assert len({w for _, t in rows for w in t.split()}) > 1500
    wanted = {i for i, _ in rows if i % 2}
    docs = documents(spark, rows)
    target = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    want = plain_losses(rows, wanted)
    usual = lm_score.WORDS, lm_score.FREQUENT, lm_score.SHARE
    for words, frequent, share in (usual, (5, 400, 300), (5, 1 << 19, 300), (0, 1 << 19, 1 << 21), (0, 1, 1 << 21)):
        monkeypatch.setattr(lm_score, "WORDS", words)
        monkeypatch.setattr(lm_score, "FREQUENT", frequent)
        monkeypatch.setattr(lm_score, "SHARE", share)
        models = lm_score.fit(docs, target)
        for other in (docs, documents(spark, rows, 2)):
            got = lm_score.scored(other, models).collect()
            assert len(got) == len(rows)
            for r in got:
                n, a, b = want[r.doc_id]
                assert r.n_tokens == n and np.allclose([r.target_loss, r.background_loss, r.score], [a, b, b - a])


def test_language_models_are_distributions():
    """What the operator is compared with sums to one over the vocabulary."""
    rows = made(n=30)
    _, words, *models = plain_models(rows, {i for i, _ in rows if i % 2})
    for loss in models:
        for h in ("<s>", words[0], words[-2], "unseen"):
            assert np.isclose(sum(np.exp(-loss(h, w)) for w in words), 1)


@pytest.mark.parametrize("frequent", [1 << 19, 2])
def test_language_models_with_a_word_that_is_a_third_of_all(spark, monkeypatch, frequent):
    """Frequent or rare, dealt to many parts, beside a text that holds most tokens."""
    rng = random.Random(5)
    rows = [(i, " ".join("the" if rng.random() < 0.34 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(90)))) for i in range(60)]
    rows.append((60, " ".join(f"the v{k % 999}" for k in range(3000))))
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    monkeypatch.setattr(lm_score, "WORDS", 3)
    monkeypatch.setattr(lm_score, "SHARE", 100)
    monkeypatch.setattr(lm_score, "TASKS", 7)
    docs = documents(spark, rows)
    wanted = set(range(0, 60, 3))
    target = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    got = {r.doc_id: r for r in lm_score.scored(docs, lm_score.fit(docs, target)).collect()}
    for i, (n, a, b) in plain_losses(rows, wanted).items():
        assert got[i].n_tokens == n and np.allclose([got[i].target_loss, got[i].background_loss], [a, b])


def test_language_models_on_odd_rows(spark):
    ids = spark.createDataFrame([(4,), (None,)], "doc_id long")
    got = lm_score.scored(odd(spark), lm_score.fit(odd(spark), ids)).collect()
    assert len(got) == 16 and all(np.isfinite([r.score, r.target_loss]).all() for r in got)
    assert {(r.n_tokens, r.score) for r in got if r.doc_id in (1, 2, 8)} == {(0, 0.0)}
    models = lm_score.fit(nothing(spark), ids.limit(0))
    assert lm_score.scored(nothing(spark), models).collect() == []
    assert len(lm_score.scored(odd(spark), models).collect()) == 16


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "and", "th"], "de": ["sch", "ung", "ein", "der", "ß"], "fr": ["eau", "que", "é", "les", "ent"]}
    rows = []
    for i in range(150):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(30)), lang, "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, language_mix.fit(docs.where("doc_id < 90")), parts


def test_languages_of_held_out_documents(tongues):
    docs, model, _ = tongues
    rows = docs.where("doc_id >= 90").join(language_mix.predicted(docs, model).drop("lang"), "doc_id").collect()
    assert all(r.lang == r.lang_pred and r.score > 0.9 and sum(p > 0 for p in r.proportions) == 1 for r in rows)


def test_a_mixed_document_has_its_proportions(spark, tongues):
    _, model, parts = tongues
    rng = random.Random(3)
    words = ["".join(rng.choices(parts["en"], k=2)) for _ in range(150)] + ["".join(rng.choices(parts["fr"], k=2)) for _ in range(50)]
    row = language_mix.predicted(documents(spark, [(1, " ".join(words))]), model).first()
    share = dict(zip(model.languages, row.proportions))
    assert row.lang_pred == "en" and abs(share["en"] - 0.75) < 0.05 and abs(share["fr"] - 0.25) < 0.05 and share["de"] == 0


def test_counts_cover_every_training_text(spark, tongues):
    docs, model, _ = tongues
    total = np.exp(model.log.astype(float)).sum(0)
    assert model.languages == ("de", "en", "fr") and np.allclose(total, 1, atol=1e-3)


def test_languages_of_odd_rows(spark, tongues):
    _, model, _ = tongues
    got = language_mix.predicted(odd(spark), model).collect()
    of = {r.doc_id: r for r in got}
    assert len(got) == 16 and all(0 <= r.score <= 1 for r in got)
    assert {of[k].lang_pred for k in (1, 2, 8, 11)} == {"und"} and of[9].lang_pred != "und" and of[4].lang_pred in model.languages
    none = language_mix.fit(nothing(spark))
    assert none.languages == () and {r.lang_pred for r in language_mix.predicted(odd(spark), none).collect()} == {"und"}
    assert language_mix.predicted(nothing(spark), model).collect() == []


def plain_mixture(likely):
    """Expectation-maximisation word by word, and the set of languages by penalised likelihood, for one document."""
    n, langs = len(likely), len(likely[0])

    def run(share):
        for _ in range(language_mix.ROUNDS):
            parts = []
            for word in likely:
                part = [s * math.exp(x) for s, x in zip(share, word)]
                parts.append([p / sum(part) for p in part])
            share = [sum(p[k] for p in parts) / n for k in range(langs)]
        return share, sum(math.log(sum(s * math.exp(x) for s, x in zip(share, word))) for word in likely)

    every, _ = run([1 / langs] * langs)
    order = sorted(range(langs), key=lambda k: -every[k])
    found = []
    for size in range(1, langs + 1):
        start = [max(every[k], 1e-3) if k in order[:size] else 0.0 for k in range(langs)]
        share, fit = run([s / sum(start) for s in start])
        found.append((fit - language_mix.PENALTY * (size - 1) * math.log(n + 1), share))
    return max(found, key=lambda f: f[0])[1], every


def test_mixtures_equal_plain_expectation_maximisation():
    rng = np.random.default_rng(4)
    for langs in (1, 2, 4):
        sizes = rng.integers(1, 30, 25)
        likely = rng.normal(-8, 3, (sizes.sum(), langs))
        first = np.cumsum(sizes) - sizes
        mix, every = language_mix.mixtures(likely, first, sizes)
        for k, (a, n) in enumerate(zip(first, sizes)):
            want, of_all = plain_mixture(likely[a:a + n].tolist())
            assert np.allclose(mix[k], want, atol=1e-4) and np.allclose(every[k], of_all, atol=1e-4)


def test_trigrams_equal_plain_counts(spark):
    """Also at the edges of texts, next to empty ones, and around signs and capitals."""
    rows = [(1, "Ab c"), (2, ""), (3, "xyz"), (4, "a1b,É z"), (5, "q")]
    model = language_mix.fit(documents(spark, rows, 2))
    want = np.full(language_mix.BUCKETS, language_mix.PRIOR)
    for _, text in rows:
        data = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()]
        padded = [32, *data, 32]
        for k, b in enumerate(data):
            if b != 32:
                packed = padded[k] << 16 | b << 8 | padded[k + 2]
                want[(packed * 0x9E3779B1 & 0xFFFFFFFF) >> 16] += 1
    assert model.languages == ("en",) and np.allclose(np.exp(model.log[:, 0].astype(float)), want / want.sum(), rtol=1e-4)


def test_gradients_equal_numerical_ones():
    """Of every parameter of the network, by the change of the cross-entropy."""
    rng = np.random.default_rng(6)
    net = quality_net.Net(*(p.astype(np.float64) for p in quality_net.fresh(3)))
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in (5, 70, 300, 1000)]
    size = np.array([len(t) for t in texts])
    data, ends, labels = np.concatenate(texts), np.cumsum(size), np.array([1, 0, 1, 0])

    def loss():
        p = quality_net.score_rows(net, quality_net.tables(net), data, ends - size, ends)
        return -np.mean(np.log(np.where(labels == 1, p, 1 - p)))

    grads = quality_net._gradients(net, data, ends - size, ends, labels)
    for values, grad in zip(net, grads):
        flat = values.reshape(-1)
        for k in {*np.argsort(-np.abs(grad).ravel())[:3].tolist(), *rng.integers(0, flat.size, 3).tolist()}:
            kept, step = flat[k], 1e-6
            flat[k] = kept + step
            above = loss()
            flat[k] = kept - step
            below = loss()
            flat[k] = kept
            assert np.isclose((above - below) / (2 * step), grad.ravel()[k], rtol=2e-3, atol=1e-5)
