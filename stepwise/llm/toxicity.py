"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .shared import STEP_CHARS, Mapper, fold, fresh, in_short_batches, in_steps, smallest, stage, text_or_empty

#: Bits of a hashed feature.
BITS = 22
#: Texts that a model is fitted on, at most: confirmed toxic ones, and unlabelled ones.
POSITIVES, UNLABELLED = 2000, 4000
#: A feature is kept if it is, beyond chance, this many times as frequent in the toxic texts as in the others.
LIFT = 2.0
EPOCHS = 400
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.7


class Model(NamedTuple):
    #: Sorted hashed features, their weights, and the intercept.
    features: np.ndarray
    weights: np.ndarray
    bias: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for each distinct hashed feature of a text: whole words and the first 4 and 5 letters of longer ones."""
    w = flat.words(texts)
    docs, found = [], []
    for salt, size in ((1, None), (2, 4), (3, 5)):
        long = np.ones(len(w.start), bool) if size is None else w.end - w.start > size
        start = w.start[long]
        end = w.end[long] if size is None else start + size
        docs.append(w.doc[long])
        found.append(flat.mix(flat.span_hash(w, start, end, salt), BITS))
    both = np.sort((np.concatenate(docs) << BITS) | np.concatenate(found))
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    return both >> BITS, both & ((1 << BITS) - 1)


Texts = tuple[np.ndarray, np.ndarray, int]


def risk_and_slope(theta: np.ndarray, positive: Texts, unlabelled: Texts, prior: float) -> tuple[float, np.ndarray]:
    """What a step lowers, and its slope by ``theta`` (weights, then the intercept); texts are (text, feature) and their number.

    The risk is prior * E+[l(+z)] + max(0, Eu[l(-z)] - prior * E+[l(-z)]): the
    unlabelled texts stand for negatives after the toxic share among them is
    taken out.  Where that difference turns negative (the model begins to fit
    the unlabelled toxic texts as clean), its opposite is lowered instead.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    z_p, z_u = (theta[-1] + np.bincount(doc, theta[f], minlength=n) for doc, f, n in (positive, unlabelled))
    n_p, n_u = max(1, len(z_p)), max(1, len(z_u))
    loss = lambda z: float(np.logaddexp(0, -z).sum())
    negative = loss(-z_u) / n_u - prior * loss(-z_p) / n_p
    if negative >= 0:
        risk = prior * loss(z_p) / n_p + negative
        s_p, s_u = -prior * (sigmoid(-z_p) + sigmoid(z_p)) / n_p, sigmoid(z_u) / n_u
    else:
        risk = -negative
        s_p, s_u = prior * sigmoid(z_p) / n_p, -sigmoid(z_u) / n_u
    slope = np.zeros(len(theta))
    slope[-1] = s_p.sum() + s_u.sum()
    for (doc, f, _), s in ((positive, s_p), (unlabelled, s_u)):
        slope[:-1] += np.bincount(f, s[doc], minlength=len(theta) - 1)
    return risk, slope


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Minimise the non-negative PU risk of a logistic model over selected features, by Adam with decay."""
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    count = lambda rows: np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=1 << BITS)
    c_p, c_u = count(positive), count(unlabelled)
    # No other feature can be frequent in the toxic texts.
    there = np.flatnonzero(c_p)
    c_p, c_u = c_p[there].astype(float), c_u[there].astype(float)
    low, high = (c_p - 2 * np.sqrt(c_p)) / n_p, (c_u + 2 * np.sqrt(c_u) + 1) / n_u
    chosen = there[low > LIFT * high]
    if not len(chosen):
        return Model(chosen, np.zeros(0), -5.0)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def texts_of(rows: list[np.ndarray]) -> Texts:
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = place[np.concatenate([np.zeros(0, np.int32), *rows])]
        return doc[at >= 0], at[at >= 0], len(rows)

    sets = texts_of(positive), texts_of(unlabelled)
    theta = np.append(np.zeros(len(chosen)), -1.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        slope = risk_and_slope(theta, *sets, prior)[1]
        slope[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, theta[:-1], float(theta[-1]))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    doc, found = features(texts)
    at = np.minimum(np.searchsorted(model.features, found), max(0, len(model.features) - 1))
    hit = model.features[at] == found if len(model.features) else np.zeros(len(found), bool)
    z = model.bias + np.bincount(doc[hit], model.weights[at[hit]], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[np.ndarray] = []
        for group in in_steps(batch.column("text").to_pylist()):
            doc, found = features(group)
            rows += np.split(found.astype(np.int32), np.searchsorted(doc, np.arange(1, len(group))))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "f"])


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[DataFrame, float]:
    """(toxic, text) that a model is fitted on, and the class prior.

    At most ``positives`` confirmed toxic documents and ``unlabelled`` others,
    each a doc_id outside the held-out fold with one text, however often it is
    repeated: those of the smallest hashes of their ids.  The prior is the toxic
    share among the labelled ids outside the fold that have a text; it is right for the corpus as
    far as labels were given without regard to toxicity.
    """
    learn = fold("doc_id", 3) != 1
    rows = docs.select("doc_id", "text").where(learn & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Labels of documents that aren't there, or have no text, take no place.
    known = stage(known.join(rows.select("doc_id"), "doc_id", "left_semi"), "known")
    share = known.agg(F.avg("toxic").alias("p")).first()["p"]
    near = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    yes = smallest(known.where("toxic = 1").select("doc_id"), "doc_id", near, positives).withColumn("toxic", F.lit(1))
    no = smallest(rows.select("doc_id"), "doc_id", near, unlabelled).withColumn("toxic", F.lit(0))
    # At most positives + unlabelled rows are broadcast.
    chosen = stage(yes.unionByName(no), "chosen")
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("toxic", "text"), float(share or 0.0)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on ``sample``; of its texts only the distinct features come to the driver."""
    rows, prior = sample(docs, labels, positives, unlabelled)
    got = rows.mapInArrow(in_short_batches(_features), "toxic int, f array<int>").toArrow()
    toxic = got.column("toxic").to_numpy()
    lists: list[np.ndarray] = []
    for chunk in got.column("f").chunks:
        held, size = chunk.flatten().to_numpy(), chunk.value_lengths().to_numpy()
        lists += [held[end - n : end] for end, n in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)]
    # In an order that the tasks' don't change.
    rows_of = lambda v: sorted((x for x, t in zip(lists, toxic, strict=True) if t == v), key=lambda x: (len(x), int(x.sum())))
    return fit(rows_of(1), rows_of(0), prior)


def _scores(model, name: str = "score") -> Mapper:
    """Add the score of column ``text`` to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [score_texts(model.value, group) for group in in_steps(batch.column("text").to_pylist(), STEP_CHARS)]
            score = pa.array(np.concatenate(done) if done else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    return in_short_batches(run)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text, score`` of each row: one pass over the whole texts, no shuffle.  Null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(_scores(sent), f"doc_id {kind}, text string, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    The score is the model's probability for the distinct words and word
    beginnings of the whole text, however long; a null or empty text gets that
    of a text without known features.  Rows that repeat a doc_id are scored
    each; labels that repeat one count as toxic if any does; without toxic
    labels every score is low.  An empty table gives no rows.  Other columns are
    not read, whatever their names.
    """
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns unchanged, whatever their names.

    Null and empty texts are judged as texts without known features, repeated
    rows each alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    name = fresh("score", docs)
    kept = docs.mapInArrow(_scores(sent, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
    return kept.where(F.col(name) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
