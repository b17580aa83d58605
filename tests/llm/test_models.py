"""The two classifiers: their mathematics against plain forms, their samples, and planted texts."""

import itertools
import random
import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stepwise.llm import flat, language_id, toxicity

# Language: the chain.


@pytest.mark.parametrize("size", [1, 2, 3, 64])
def test_forward_backward_equals_enumeration(size):
    rng = np.random.default_rng(7)
    k, lengths = 3, [1, 6, 3, 5, 2, 4]
    model = language_id.Model(list("abc"), None, rng.normal(size=(k, k)) * 2, rng.normal(size=k))
    chain = np.repeat(np.arange(len(lengths)), lengths)
    emit = rng.normal(size=(len(chain), k)) * 3
    want, moves = np.zeros_like(emit), np.zeros((k, k))
    for c in range(len(lengths)):
        at = np.flatnonzero(chain == c)
        weights = {}
        for y in itertools.product(range(k), repeat=len(at)):
            weights[y] = np.exp(model.starts[y[0]] + sum(emit[i, a] for i, a in zip(at, y, strict=True)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(y)))
        total = sum(weights.values())
        for y, w in weights.items():
            for i, a in zip(at, y, strict=True):
                want[i, a] += w / total
            for a, b in itertools.pairwise(y):
                moves[a, b] += w / total
    post, pairs = language_id.forward_backward(emit, chain, model, size=size, expected=True)
    assert np.allclose(post, want) and np.allclose(pairs, moves)


def test_long_chains_are_not_cut():
    rng = np.random.default_rng(3)
    model = language_id.Model(list("ab"), None, np.array([[4.0, -4.0], [-4.0, 4.0]]), np.zeros(2))
    emit = np.zeros((5000, 2))
    emit[0] = (9, 0)
    post, _ = language_id.forward_backward(emit, np.zeros(5000, np.int64), model)
    stay = np.exp(4) / (np.exp(4) + np.exp(-4))
    # What the first word says is still felt far behind: the chain's own decay, and no cut.
    assert post[300, 0] == pytest.approx(0.5 + 0.5 * (2 * stay - 1) ** 300, abs=1e-3)
    emit = rng.normal(size=(3000, 2))
    a, b = (language_id.forward_backward(emit, np.zeros(3000, np.int64), model, size=s)[0] for s in (64, 3000))
    assert np.allclose(a, b)


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    return docs, language_id.train(docs)


def test_words_of_code_switched_texts(labelled):
    docs, model = labelled
    held = docs.where((F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 4)") == 2) & F.col("lang").isNotNull() & (F.length("text") > 200)).select("lang", "text").collect()
    rng = random.Random(4)
    words = right = near = 0
    for _ in range(60):
        parts = []
        for r in rng.sample(held, 4):
            own = r["text"].split()
            at = rng.randrange(max(1, len(own) - 15))
            parts.append((r["lang"], " ".join(own[at : at + 15])))
        found = language_id.predict(model, [" ".join(t for _, t in parts)])
        label = np.repeat(found.run_lang, found.stop - found.first)
        want = [model.langs.index(lang) for lang, t in parts for _ in language_id.flat.words([t]).start]
        assert len(label) == len(want) and found.first[0] == 0 and (found.first[1:] == found.stop[:-1]).all()
        words += len(want)
        right += int((label == np.array(want)).sum())
        near += len(found.first)
    assert right / words > 0.9, right / words


def test_each_language_is_learned_and_samples_are_bounded(spark):
    common = [(i, f"this is the text number {i % 7} of them", "en") for i in range(3000)]
    hot = [(1, "this is one text that comes again", "en")] * 3000
    rare = [(100_000 + i, "dies ist ein seltener Satz", "de") for i in range(3)] + [(200_000, "nul", None), (200_001, None, "xx")]
    docs = spark.createDataFrame(common + hot + rare, "doc_id long, text string, lang string").repartition(8)
    got = language_id.sample(docs, per_language=50).groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in got}
    assert counts["en"] == 50 and 1 <= counts["de"] <= 3 and set(counts) == {"en", "de"}
    out = {r["doc_id"]: r for r in language_id.languages(docs).collect()}
    assert out[100_000]["lang_pred"] == "de" and out[2]["lang_pred"] == "en" and out[200_001]["lang_pred"] == "und" and out[200_001]["spans"] == []
    assert [(s["first"], s["stop"]) for s in out[100_000]["spans"]] == [(0, 5)]


# Toxicity: the risk.


def _texts(rng, n, features):
    doc = np.repeat(np.arange(n), 3)
    return doc, rng.integers(0, features, len(doc)), n


@pytest.mark.parametrize(("prior", "bias"), [(0.2, -1.0), (0.9, 2.0)])
def test_slope_equals_finite_differences(prior, bias):
    rng = np.random.default_rng(2)
    positive, unlabelled = _texts(rng, 9, 5), _texts(rng, 14, 5)
    theta = np.append(rng.normal(size=5) * 0.3, bias)
    if prior > 0.5:
        # Unlabelled texts that all look clean: the corrected risk is negative.
        theta[:5] = 0
        unlabelled = (np.zeros(0, np.int64), np.zeros(0, np.int64), 14)
        theta[:5], positive = 3.0, _texts(rng, 9, 5)
        theta[-1] = -3.0
    risk, slope = toxicity.risk_and_slope(theta, positive, unlabelled, prior)
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    z_p, z_u = (theta[-1] + np.bincount(d, theta[f], minlength=n) for d, f, n in (positive, unlabelled))
    negative = loss(-z_u) - prior * loss(-z_p)
    assert (negative < 0) == (prior > 0.5)
    assert risk == pytest.approx(prior * loss(z_p) + negative if negative >= 0 else -negative)
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-5
        up, down = (toxicity.risk_and_slope(theta + s, positive, unlabelled, prior)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_sample_is_bounded_whatever_is_repeated(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(7, f"again {i}") for i in range(300)] + [(None, "none"), (60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1)] * 20 + [(i, 0) for i in range(8, 40)], "doc_id long, toxic int")
    got, prior = toxicity.sample(docs, labels, positives=5, unlabelled=20)
    counts = {r["toxic"]: r["count"] for r in got.groupBy("toxic").count().collect()}
    assert counts[0] == 20 and counts.get(1, 0) <= 1 and 0 <= prior <= 1
    assert toxicity.sample(docs, labels, unlabelled=200)[0].count() <= 50


def test_labels_of_absent_documents_take_no_place(spark):
    """13 toxic documents, and thousands of toxic labels of documents that are not there or have no text."""
    docs = [(i, "an awful vile text" if i < 20 else f"a calm note {i}") for i in range(300)] + [(i, None) for i in range(300, 400)]
    labels = [(i, 1 if i < 20 else 0) for i in range(100)] + [(i, 1) for i in range(300, 6000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows, prior = toxicity.sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), positives=20)
    plain, prior_of_present = toxicity.sample(docs, spark.createDataFrame(labels[:100], "doc_id long, toxic int"), positives=20)
    assert rows.where("toxic = 1").count() == plain.where("toxic = 1").count() > 10
    assert prior == prior_of_present and 0.1 < prior < 0.4


def plain_score(model, text):
    """The score by a dict of weights: distinct words and the first letters of longer ones, hashed one by one."""
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    found = set()
    for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text.lower())):
        for salt, part in ((1, word), *((2, word[:4]) for _ in range(len(word) > 4)), *((3, word[:5]) for _ in range(len(word) > 5))):
            h, power = 0, 1
            for c in part:
                h, power = (h + (ord(c) + 1) * power) % 2**64, power * flat._ODD % 2**64
            h = (h * (2 * salt + 1) + salt) % 2**64
            for shift in (31, 29):
                h = (h ^ h >> shift) * int(flat._FACTOR) % 2**64
            found.add(h >> (64 - toxicity.BITS))
    z = model.bias + sum(weights.get(f, 0.0) for f in found)
    return 1 / (1 + np.exp(-z))


def test_scores_equal_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = toxicity.scored(docs, model).collect()
    assert len(model.features) and all(abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-9 for r in rows)
