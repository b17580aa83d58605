"""Language identification of code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .shared import STEP_CHARS, fold, in_short_batches, in_steps, small, stage, text_or_empty

#: Bits of a hashed feature.
BITS = 18
#: Texts of each language that the model is fitted on, at most (whole ones).
SAMPLE = 400
#: Languages whose tables are broadcast, at most; those of more are joined by a shuffle.
LANGUAGES = 500
#: Words that are worked through one by one, in all blocks of a chain side by side.
BLOCK = 64
#: Of 4 groups of texts that the model is fitted on one is of code-switched ones, made of runs of so many words.
RUN = (3, 40)
EPOCHS = 4
RATE = 0.3
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    #: Feature weights (features x labels), transitions (from x to) and starts.
    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray


def word_features(w: flat.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each word: lexicon, 3 prefixes, 3 suffixes), (hashed letter trigrams), (trigrams before each word, and all)."""
    own = [flat.mix(flat.span_hash(w, w.start, w.end, 1), BITS)]
    for size in (1, 2, 3):
        own.append(flat.mix(flat.span_hash(w, w.start, np.minimum(w.start + size, w.end), 10 + size), BITS))
        own.append(flat.mix(flat.span_hash(w, np.maximum(w.end - size, w.start), w.end, 20 + size), BITS))
    inside = np.flatnonzero(w.letter[:-2] & w.letter[1:-1] & w.letter[2:]) if len(w.letter) > 2 else np.zeros(0, np.int64)
    grams = flat.mix(flat.span_hash(w, inside, inside + 3, 30), BITS)
    first = np.searchsorted(inside, w.start)
    return np.stack(own, axis=1) if len(w.start) else np.zeros((0, 7), np.int64), grams, np.append(first, len(inside))


def emissions(weights: np.ndarray, own: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's score for each label; its trigrams count as their mean."""
    out = np.zeros((len(own), weights.shape[1]), np.float64)
    for f in own.T:
        out += weights[f]
    sums = np.concatenate((np.zeros((1, weights.shape[1])), np.cumsum(weights[grams], axis=0, dtype=np.float64)))
    n = np.diff(first)[:, None]
    return out + (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)


def blocks(chain: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each word, place in it, whether each block begins a chain): a chain's words in runs of ``size``."""
    new = np.append(True, chain[1:] != chain[:-1])[: len(chain)]
    place = np.arange(len(chain)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(chain) else np.zeros(0, np.int64)
    starts = place % size == 0
    return np.cumsum(starts) - 1, place % size, new[starts]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def forward_backward(emit: np.ndarray, chain: np.ndarray, model: Model, size: int = BLOCK, expected: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each word's label probabilities, and with ``expected`` the expected transitions of all chains together.

    Exact for chains of any length.  A block's words are multiplied into one
    matrix, from its first label to its last, all blocks side by side; what
    stands before and behind each block then follows from block to block, and
    within the blocks from word to word.
    """
    block, at, first = blocks(chain, size)
    k, n = emit.shape[1], len(first)
    length = np.bincount(block, minlength=n)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    live = np.searchsorted(-length[order], -np.arange(size + 1), side="left")  # blocks longer than t
    e = np.ones((size, n, k))
    e[at, rank[block]] = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(model.transitions - model.transitions.max())
    starts = _scaled(np.exp(model.starts - model.starts.max()))

    whole, scale = np.zeros((n, k, k)), np.zeros((n, k))
    whole[:, np.arange(k), np.arange(k)] = e[0]
    for t in range(1, size):
        m = live[t]
        if not m:
            break
        step = (whole[:m].reshape(-1, k) @ move).reshape(m, k, k) * e[t, :m, None, :]
        top = step.max(axis=2)
        whole[:m] = step / top[:, :, None]
        scale[:m] += np.log(top)
    log = lambda x: np.log(np.maximum(x, 1e-300))

    # From block to block, all chains side by side.
    heads = np.flatnonzero(first)
    count = np.diff(np.append(heads, n))
    by_count = np.argsort(-count, kind="stable")
    heads, count = heads[by_count], count[by_count]
    running = np.searchsorted(-count, -np.arange(int(count.max()) + 1), side="left")
    before, behind = np.empty((n, k)), np.ones((n, k))
    before[rank[heads]] = starts
    for s in range(1, int(count.max())):
        last, here = rank[heads[: running[s]] + s - 1], rank[heads[: running[s]] + s]
        weight = log(before[last]) + scale[last]
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        before[here] = _scaled(np.einsum("ni,nij->nj", weight, whole[last]) @ move)
    for s in range(int(count.max()) - 1, 0, -1):
        last, here = rank[heads[: running[s]] + s - 1], rank[heads[: running[s]] + s]
        weight = log(np.einsum("nij,nj->ni", whole[here], behind[here])) + scale[here]
        behind[last] = _scaled(np.exp(weight - weight.max(axis=1, keepdims=True)) @ move.T)

    # Within the blocks.
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0] = _scaled(before * e[0])
    beta[length[order] - 1, np.arange(n)] = behind
    for t in range(1, size):
        m = live[t]
        alpha[t, :m] = _scaled((alpha[t - 1, :m] @ move) * e[t, :m])
    for t in range(size - 2, -1, -1):
        m = live[t + 1]
        beta[t, :m] = _scaled((beta[t + 1, :m] * e[t + 1, :m]) @ move.T)
    place = rank[block]
    post = _scaled(alpha[at, place] * beta[at, place])
    if not expected:
        return post, None
    pairs = np.zeros((k, k))
    inner = np.flatnonzero(~first)
    for a, b in [(alpha[t - 1, : live[t]], e[t, : live[t]] * beta[t, : live[t]]) for t in range(1, size)] + [(alpha[length[inner - 1] - 1, rank[inner - 1]], (e[0] * beta[0])[rank[inner]])]:
        pairs += ((a / ((a @ move) * b).sum(axis=1, keepdims=True)).T @ b) * move
    return post, pairs


def switched(texts: list[str], label: np.ndarray, rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Code-switched texts made of ``texts``: (pieces, the text each piece is in, its label)."""
    pieces, inside, langs = [], [], []
    words = [t.split() for t in texts]
    full = [i for i, w in enumerate(words) if w]
    for text in range(len(full)):
        for _ in range(int(rng.integers(2, 12))):
            i = full[int(rng.integers(len(full)))]
            n = int(rng.integers(RUN[0], RUN[1] + 1))
            at = int(rng.integers(max(1, len(words[i]) - n + 1)))
            pieces.append(" ".join(words[i][at : at + n]))
            inside.append(text)
            langs.append(label[i])
    return pieces, np.array(inside, np.int64), np.array(langs, np.int64)


def fit(texts: list[str], langs: list[str], seed: int = 42) -> Model:
    """Maximise the words' labels' likelihood by AdaGrad over groups of texts.

    A text's words all have its language.  Every fourth group is of code-switched
    texts, runs of words of several texts, so that the transitions learn what
    it is to stay and to switch.
    """
    names = sorted(set(langs))
    k = len(names)
    label = np.array([names.index(x) for x in langs], np.int64)
    model = Model(names, np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k))
    if not k:
        return model
    seen_w, seen_t, seen_s = np.full((1 << BITS, k), 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        groups: list[list[int]] = []
        for i in order.tolist():
            if not groups or len(groups[-1]) == 64 or sum(len(texts[j]) for j in groups[-1]) + len(texts[i]) > STEP_CHARS // 2:
                groups.append([])
            groups[-1].append(i)
        for number, group in enumerate(groups):
            if number % 4 == 3:
                pieces, inside, own_label = switched([texts[i] for i in group], label[group], rng)
            else:
                pieces, inside, own_label = [texts[i] for i in group], np.arange(len(group)), label[group]
            w = flat.words(pieces)
            if not len(w.start):
                continue
            own, grams, start = word_features(w)
            gold, chain = own_label[w.doc], inside[w.doc]
            post, pairs = forward_backward(emissions(model.weights, own, grams, start), chain, model, expected=True)
            post[np.arange(len(gold)), gold] -= 1
            slope = post / len(gold) * 64
            gram_word = np.repeat(np.arange(len(own)), np.diff(start))
            at_f = np.concatenate((own.ravel(), grams))
            values = np.concatenate((np.repeat(slope, own.shape[1], axis=0), (slope / np.maximum(np.diff(start), 1)[:, None])[gram_word]))
            used, back = np.unique(at_f, return_inverse=True)
            g = np.stack([np.bincount(back, values[:, j], minlength=len(used)) for j in range(k)], axis=1)
            seen_w[used] += g**2
            model.weights[used] -= RATE * g / np.sqrt(seen_w[used])
            follows = np.flatnonzero(chain[1:] == chain[:-1]) + 1
            np.subtract.at(pairs, (gold[follows - 1], gold[follows]), 1)
            pairs *= 64 / len(gold)
            seen_t += pairs**2
            model.transitions[:] -= RATE * pairs / np.sqrt(seen_t)
            g_s = slope[np.append(True, chain[1:] != chain[:-1])].sum(axis=0)
            seen_s += g_s**2
            model.starts[:] -= RATE * g_s / np.sqrt(seen_s)
    return model


class Labelled(NamedTuple):
    #: Each text's language and its share of the words' probability.
    lang: list[str]
    score: np.ndarray
    #: Runs of words of one label: the text of each, its first word, the one behind its last, its language.
    doc: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    run_lang: np.ndarray


def predict(model: Model, texts: list[str]) -> Labelled:
    """Label every word by its most probable language, and each text by that of most of its words' probability."""
    w = flat.words(texts)
    total = np.zeros((len(texts), max(1, len(model.langs))))
    n_words = np.bincount(w.doc, minlength=len(texts))
    none = np.zeros(0, np.int64)
    runs = (none, none, none, none)
    if len(w.start) and model.langs:
        own, grams, first = word_features(w)
        post, _ = forward_backward(emissions(model.weights, own, grams, first), w.doc, model)
        for j in range(len(model.langs)):
            total[:, j] = np.bincount(w.doc, post[:, j], minlength=len(texts))
        best = post.argmax(axis=1)
        begin = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (w.doc[1:] != w.doc[:-1])))
        place = np.arange(len(best)) - (np.cumsum(n_words) - n_words)[w.doc]
        runs = (w.doc[begin], place[begin], place[np.append(begin[1:] - 1, len(best) - 1)] + 1, best[begin])
    top = total.argmax(axis=1)
    score = np.clip(total[np.arange(len(texts)), top] / np.maximum(n_words, 1), 0, 1)
    return Labelled([model.langs[b] if n and model.langs else UNKNOWN for b, n in zip(top, n_words, strict=True)], score, *runs)


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(lang, text): at most ``per_language`` whole texts of each language, of rows outside the held-out fold.

    Those of the smallest hashes of their ids and texts, each once, however
    often it is repeated.  Only hashes meet for the choice.
    """
    rows = docs.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64(F.lit("language"), F.col("doc_id"), F.xxhash64("text")).alias("key"))
    # A cut by the number of a language's rows lets about twice as many through to the last choice.
    seen = stage(rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")), "seen")
    share = (2 * per_language + 1000) / F.col("n")
    seen = seen.select("lang", F.when(share < 1, (share * float(1 << 64) - float(1 << 63)).cast("long")).otherwise((1 << 63) - 1).alias("cut"))
    near = rows.select("lang", "key").join(small(seen, LANGUAGES), "lang").where(F.col("key") <= F.col("cut")).select("lang", "key").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = stage(near.withColumn("turn", turn).where(F.col("turn") <= per_language).select("lang", "key"), "chosen")
    rows = rows.join(small(chosen, LANGUAGES * SAMPLE), ["lang", "key"])
    return rows.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    got = sorted(map(tuple, sample(docs, per_language).collect()))
    return fit([t for _, t in got], [x for x, _ in got])


SPANS = "array<struct<first:int,stop:int,lang:string>>"


def _predictions(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(sent.value.langs, pa.string())
        for batch in batches:
            for group, texts in in_groups(batch):
                found = predict(sent.value, texts)
                n = np.bincount(found.doc, minlength=len(texts))
                runs = pa.StructArray.from_arrays([pa.array(found.first, pa.int32()), pa.array(found.stop, pa.int32()), names.take(pa.array(found.run_lang))], ["first", "stop", "lang"])
                spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([group.column("doc_id"), pa.array(found.lang, pa.string()), pa.array(found.score, pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    return in_short_batches(run)


def in_groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Neighbouring rows of at most STEP_CHARS characters, and their texts."""
    at = 0
    for texts in in_steps(batch.column("text").to_pylist(), STEP_CHARS):
        yield batch.slice(at, len(texts)), texts
        at += len(texts)


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, spans.

    The chain labels every word of the whole text, however long, by forward-
    backward; ``spans`` are its runs of words (letters; ``first`` from 0,
    ``stop`` exclusive) of one language.  The language with most of the words'
    probability is the text's, and its share the score.  A text that is null or
    has no letter is ``und`` with score 0 and no spans, as is any text where no
    language was learned; rows that repeat a doc_id are labelled each; rows with
    a null lang are not learned from.  An empty table gives no rows.  Other
    columns are not read, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    out = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_predictions(sent), f"doc_id {kind}, lang_pred string, score double, spans {SPANS}")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "spans")
