"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, their first letters (``STEM`` bytes, which
catches inflected forms), pairs of neighbouring words and pairs one word apart, hashed into
2^20 places. Per-coordinate learning rates and an L1 penalty leave a few hundred weights, which
is what the scoring tasks are sent.

Fitting takes at most ``most_rows`` different labelled rows of up to ``most_bytes`` each (those with the
smallest hashes), read in one task in that order, so that a fit is repeatable. Everything else covers all rows.

Defined results: an empty or missing text has no features and scores the model's base rate. A
label that is missing is left out; where an id is labelled twice, toxic wins. Documents with the
same id are scored one by one, and equal rows teach once. Without labels of both kinds, every score is the share of toxic
labels (0 without labels). Other columns are passed through; one with the name of the new column is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.llm.frames import forget_tokens, free_name, sampled_rows, small_batches, with_text_columns
from tableops.llm.texts import MARKS, distinct, flat, mixed, ngrams, slices, words

STEM = 5
BITS = 20


@dataclass(frozen=True)
class Fitting:
    """Parameters of a fit; ``l1`` counts per training row."""

    most_rows: int = 12_288
    most_bytes: int = 1 << 20
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5e-4
    l2: float = 0.1
    least_rows: int = 3


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of all features of all texts, with repeats, and the text of each."""
    data, bounds = flat(texts)
    whole, at = words(data, bounds, MARKS)
    stems, _ = words(data, bounds, MARKS, STEM)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    parts = [(mixed(whole + np.uint64(1)), rows), (mixed(stems + np.uint64(2)), rows), ngrams(whole, at, (0, 1), 3), ngrams(whole, at, (0, 2), 4)]
    places = np.concatenate([h for h, _ in parts]) >> np.uint64(64 - BITS)
    return places.astype(np.int64), np.concatenate([r for _, r in parts]), len(at) - 1


def descend(rows: list[np.ndarray], labels: np.ndarray, how: Fitting) -> Model:
    """FTRL-proximal passes over the rows; ``rows`` holds the distinct places of each."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 40.0 * (2 * share - 1))
    seen = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    kept = [x[seen[x] >= min(how.least_rows, len(rows))] for x in rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    base_z = base_n = 0.0
    l1 = how.l1 * len(rows)

    def weights(z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((how.beta + root) / how.alpha + how.l2), 0.0)

    for _ in range(how.epochs):
        for x, y in zip(kept, labels, strict=True):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = weights(zx, root)
            base = -base_z * how.alpha / (how.beta + base_n**0.5)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + base, -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / how.alpha * w
            n[x] = nx + g * g
            base_z += g - ((base_n + g * g) ** 0.5 - base_n**0.5) / how.alpha * base
            base_n += g * g
    w = weights(z, np.sqrt(n))
    places = np.flatnonzero(w)
    return Model(places, w[places].astype(np.float32), float(-base_z * how.alpha / (how.beta + base_n**0.5)))


def fit(docs: DataFrame, labels: DataFrame, how: Fitting | None = None, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks; both hold only what may be learned from."""
    how = how or Fitting()
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("mark"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    chosen = sampled_rows(rows, how.most_rows, how.most_bytes, marks)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = [], []
        forget_tokens()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                places, of, n = features(part.column("text"))
                key = distinct((of << BITS) | places)
                rows += [x.astype(np.int32) for x in np.split(key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(1, n)))]
                marks += part.column("mark").to_pylist()
        model = descend(rows, np.array(marks, float), how)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.places, -1)), pa.array(np.append(model.weights, model.bias).astype(float))], names=["place", "weight"])

    made = chosen.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "text").mapInArrow(learn, "place long, weight double").toPandas()
    base = made["place"] < 0
    return Model(made["place"][~base].to_numpy(), made["weight"][~base].to_numpy(np.float32), float(made["weight"][base].iloc[0]) if base.any() else -40.0)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1) added; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.places, model.weights, model.bias))
    tables: list[np.ndarray] = []

    def work(texts: pa.Array) -> list[np.ndarray]:
        if not tables:
            tables.append(Model(*sent.value).table())
        places, of, n = features(texts)
        hit = np.flatnonzero(tables[0][places])
        key = distinct((of[hit] << BITS) | places[hit])
        sums = np.bincount(key >> BITS, tables[0][key & ((1 << BITS) - 1)], minlength=n)
        return [1 / (1 + np.exp(-np.clip(sums + sent.value[2], -35, 35)))]

    return with_text_columns(docs, text, {score: T.DoubleType()}, work, keep)


def without_toxic(docs: DataFrame, model: Model, least: float = 0.7, text: str = "text") -> DataFrame:
    """The documents that score below ``least``, with their columns as they were."""
    score = free_name(docs, "score")
    return scored(docs, model, text, score).where(F.col(score) < least).drop(score)
