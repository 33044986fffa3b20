"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a lower-cased character n-gram (3 to 5 characters, hashed).
Training takes labelled rows, at most ``per_class`` of each class (the lowest hashes of the
id): document frequencies per class give each feature its log-count ratio ``r``; the
``features`` with the clearest ratios are kept, and logistic regression with an L2 penalty
is fitted on the presences scaled by ``r``. Scoring reads every whole text once.

The sample bound makes the label side of the join and the fit's input small by construction,
whatever the corpus holds; nothing else is bounded.

Defined results: a null text counts as empty and is scored like it; texts shorter than three
characters have no feature; repeated rows are scored each; a null label or a label of an
unknown document teaches nothing; with labels of one class or none, every score is that
class, or 0.5; an empty table gives an empty table. The columns ``score`` and ``predicted``
replace those of the input, other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORTEST, LONGEST, BITS = 3, 5, 20
PER_CLASS, FEATURES, THRESHOLD = 3000, 1 << 14, 0.7
#: Characters hashed at once; a single text may exceed it.
SLICE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """``place``: 0 or the 1-based feature of a bucket; ``weight``: of each feature."""

    place: np.ndarray
    weight: np.ndarray
    bias: float


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    held, size, start = [], 0, 0
    for k, text in enumerate(texts):
        held.append((text or "").lower())
        size += len(held[-1]) + LONGEST
        if size >= SLICE:
            yield start, held
            held, size, start = [], 0, k + 1
    if held:
        yield start, held


def buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram, in slices; n-grams don't span texts."""
    for start, some in _slices(texts):
        gap = "\0" * LONGEST
        code = np.frombuffer(gap.join([*some, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(code):
            continue
        ends = np.cumsum([len(t) + LONGEST for t in some])
        owner = np.repeat(np.arange(start, start + len(some)), np.diff(ends, prepend=0))[: len(code)]
        value = code.astype(np.uint64)
        real = value != 0
        rolling = value
        for n in range(2, LONGEST + 1):
            rolling = rolling[:-1] * _MIX + value[n - 1 :] + np.uint64(n)
            if n >= SHORTEST:
                whole = real[: len(rolling)] & real[n - 1 :]
                mixed = (rolling ^ (rolling >> np.uint64(29))) * _MIX
                bucket = (mixed >> np.uint64(64 - BITS)).astype(np.int32)
                yield owner[: len(rolling)][whole], bucket[whole]


def presences(texts: list[str | None], place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) once for each feature in a text; all buckets if no place is given."""
    found = []
    for owner, bucket in buckets(texts):
        if place is None:
            found.append(np.unique((owner.astype(np.int64) << BITS) | bucket))
        else:
            feature = place[bucket]
            kept = feature > 0
            found.append(np.unique((owner[kept].astype(np.int64) << BITS) | (feature[kept] - 1)))
    both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(rows: list[np.ndarray], toxic: np.ndarray, features: int, penalty: float = 2.0, steps: int = 150) -> Model:
    """The classifier of documents given as arrays of distinct buckets."""
    total = max(len(rows), 1)
    positive = float(toxic.sum())
    if positive == 0 or positive == len(rows):
        bias = 0.0 if not len(rows) else (20.0 if positive else -20.0)
        return Model(np.zeros(1 << BITS, np.int32), np.zeros(1), bias)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    label = np.repeat(toxic.astype(bool), lengths)
    df_pos = np.bincount(flat[label], minlength=1 << BITS)
    df_neg = np.bincount(flat[~label], minlength=1 << BITS)
    # Smoothing in proportion to the classes: an unseen n-gram has a ratio of zero.
    share = positive / total
    p = (df_pos + 2 * share) / (positive + 2 * share)
    q = (df_neg + 2 * (1 - share)) / (total - positive + 2 * (1 - share))
    ratio = np.log(p) - np.log(q)
    clear = np.abs(ratio) * np.sqrt(df_pos + df_neg)
    best = np.argsort(-clear, kind="stable")[:features]
    best = best[clear[best] > 0]
    place = np.zeros(1 << BITS, np.int32)
    place[best] = np.arange(1, len(best) + 1)
    feature = place[flat] - 1
    kept = feature >= 0
    doc = np.repeat(np.arange(len(rows)), lengths)[kept]
    feature = feature[kept]
    scale = ratio[best]
    x = scale[feature]
    weight, bias = np.zeros(len(best)), 0.0
    # Adam on the whole sample; classes weigh the same.
    importance = np.where(toxic > 0, 0.5 / positive, 0.5 / (total - positive))
    first, second = np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(doc, weights=x * weight[feature], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * importance
        slope = np.bincount(feature, weights=x * error[doc], minlength=len(best)) + penalty / total * weight
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return Model(place, weight * scale, float(bias))


def sample_labels(labels: DataFrame, doc_id: str, toxic: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class: those with the lowest hashes."""
    plain = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic"))
    plain = plain.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    some = [plain.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return some[0].unionAll(some[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, per_class: int, features: int) -> Model:
    """Fit on the sampled labels: features are taken in parallel, the fit is one bounded task."""

    def taken(batches):
        for batch in batches:
            owner, bucket = presences(batch.column(1).to_pylist(), None)
            ends = np.searchsorted(owner, np.arange(len(batch) + 1))
            rows = [bucket[ends[k] : ends[k + 1]].astype(np.int32) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "buckets"]
            )

    def fitted(table: pa.Table) -> pa.Table:
        rows = [np.asarray(r.values, dtype=np.int64) for r in table.column("buckets")]
        model = fit(rows, table.column("toxic").to_numpy().astype(float), features)
        return pa.table(
            {
                "place": [model.place.tobytes()],
                "weight": [np.asarray(model.weight, dtype=np.float64).tobytes()],
                "bias": [model.bias],
            }
        )

    # At most 2 * per_class rows of two numbers: a proven bound for the broadcast.
    labelled = F.broadcast(sample_labels(labels, doc_id, "toxic", per_class))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = texts.join(labelled, "doc_id").select("toxic", "text")
    found = known.mapInArrow(taken, "toxic int, buckets array<int>")
    row = found.groupBy().applyInArrow(fitted, "place binary, weight binary, bias double").first()
    if row is None:
        return fit([], np.empty(0), features)
    return Model(np.frombuffer(row["place"], np.int32), np.frombuffer(row["weight"], np.float64), row["bias"])


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def work(batches):
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            owner, feature = presences(batch.column(names.index(text)).to_pylist(), m.place)
            z = np.bincount(owner, weights=m.weight[feature], minlength=len(batch)) + m.bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            old = [batch.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*old, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"]
            )

    schema = T.StructType([docs.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(work, schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    learn_from: Column | None = None,
    per_class: int = PER_CLASS,
    features: int = FEATURES,
) -> DataFrame:
    """Train on the labels whose rows satisfy ``learn_from`` (of the label table), score all."""
    used = labels if learn_from is None else labels.where(learn_from)
    return score(docs, train(docs, used, doc_id, text, per_class, features), text)
