"""Quality: weak labels from overlapping heuristics, and a hashed linear scorer trained on them.

*Labellers.* Each looks at a share that it takes from the whole text (repeated neighbours, marks,
capitals, table bars, shouting, sentence ends, word lengths, letters) and votes good, bad or not at all.

*Label model.* Documents are counted by their votes (at most 3^8 patterns, summed up in the tasks
first), and expectation-maximisation on those counts estimates how often good and bad documents
get each vote of each labeller, and how many are good. That gives each pattern the probability that a document
with these votes is good. No labels are used.

*Scorer.* Words are described by their shape (first and last character, length, digits, whether the
word before is the same), shapes and pairs of shapes are hashed into 2^16 places, and a logistic
model on their shares is trained by FTRL-proximal on the probabilities of at most ``most_rows``
documents (those with the smallest id hashes). All other steps cover all documents.

Defined results: a text that is missing, empty or without a word gets no votes and scores 0.
Repeated rows count and are scored one by one. Without any document with words every score is 0. Other
columns, whatever their names, pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.llm.frames import forget_tokens, sampled_rows, with_text_columns
from tableops.llm.texts import flat, mixed, slices, spans, words

BITS = 16
#: name, below this share good, above this share bad; with a negative sign the other way round.
LABELLERS = (
    ("repeated", 0.10, 0.20),
    ("marks", 0.04, 0.10),
    ("capitals", 0.12, 0.35),
    ("bars", 0.00, 0.05),
    ("shouting", 0.01, 0.10),
    ("sentences", -0.03, -0.005),
    ("long", 0.15, 0.50),
    ("letters", -0.70, -0.55),
)
PATTERNS = 3 ** len(LABELLERS)
_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LETTER = _UPPER | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_PLAIN = np.isin(_ASCII, list(b" \t\n\x0b\x0c\r.,;:'\"()-?!"))


@dataclass(frozen=True)
class Fitting:
    """Parameters of the scorer's fit; ``l1`` counts per training row."""

    most_rows: int = 8_192
    most_bytes: int = 1 << 20
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-5
    l2: float = 1e-4


@dataclass(frozen=True)
class Model:
    """The probability of good for each vote pattern; the scorer's weights and bias; estimated vote rates."""

    good: np.ndarray
    weights: np.ndarray
    bias: float
    rates: np.ndarray
    share: float


def shares(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each labeller's share of each text (texts by labellers), and the number of words."""
    data, bounds = flat(texts)
    rows = len(bounds) - 1
    starts, ends = spans(data, bounds)
    at = np.searchsorted(starts, bounds)
    n = np.diff(at)
    hashes, _ = words(data, bounds)
    of = np.repeat(np.arange(rows), n)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of, flags, minlength=rows) / np.maximum(n, 1)

    def bytes_in(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind[data])))
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)

    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    last, length = data[ends - 1] if len(ends) else np.zeros(0, np.uint8), ends - starts
    letters = bytes_in(_LETTER)
    solid = np.maximum(bytes_in(~np.isin(_ASCII, list(b" \t\n\x0b\x0c\r"))), 1)
    found = [
        per_word(again),
        bytes_in(~(_LETTER | _DIGIT | _PLAIN)) / solid,
        bytes_in(_UPPER) / np.maximum(letters, 1),
        per_word((length == 1) & (last == ord("|"))),
        per_word(last == ord("!")),
        per_word((last == ord(".")) | (last == ord("?"))),
        per_word(length > 24),
        letters / solid,
    ]
    return np.stack(found, axis=1), n


def patterns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The votes of each text as one number in base 3 (0 none, 1 good, 2 bad), and its number of words."""
    found, n = shares(texts)
    votes = np.zeros(found.shape, np.int64)
    for k, (_, good, bad) in enumerate(LABELLERS):
        x = found[:, k] if bad > 0 else -found[:, k]
        votes[:, k] = np.where(x <= good, 1, np.where(x > bad, 2, 0))
    votes[n == 0] = 0
    return votes @ (3 ** np.arange(len(LABELLERS))), n


def label_model(counts: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, vote rates (good or bad, labeller, vote), and the share of good."""
    seen = np.flatnonzero(counts)
    if not len(seen):
        return np.full(len(counts), 0.5), np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    votes = seen[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    weight = counts[seen].astype(float)
    posterior = (1 + (votes == 1).sum(axis=1)) / (2 + (votes == 1).sum(axis=1) + 4 * (votes == 2).sum(axis=1))
    rates, share = np.zeros((2, len(LABELLERS), 3)), 0.5
    for _ in range(steps):
        share = float(np.clip((weight @ posterior + 1) / (weight.sum() + 2), 1e-3, 1 - 1e-3))
        for kind, p in enumerate((posterior, 1 - posterior)):
            for vote in range(3):
                rates[kind, :, vote] = ((weight * p) @ (votes == vote) + 0.1) / (weight @ p + 0.3)
        logs = [np.log(np.take_along_axis(rates[kind].T, votes, axis=0)).sum(axis=1) for kind in range(2)]
        new = 1 / (1 + np.exp(np.clip(logs[1] + np.log(1 - share) - logs[0] - np.log(share), -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    out = np.full(len(counts), share)
    out[seen] = posterior
    return out, rates, share


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and texts of all shapes and pairs of shapes, and the number of features of each text."""
    data, bounds = flat(texts)
    starts, ends = spans(data, bounds)
    n = np.diff(np.searchsorted(starts, bounds))
    of = np.repeat(np.arange(len(n)), n)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    kind = np.where(_LETTER, np.where(_UPPER, 1, 2), np.where(_DIGIT, 3, _ASCII + 4)).astype(np.uint64)
    hashes, _ = words(data, bounds)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])).astype(np.uint64)
    second = kind[data[np.minimum(starts + 1, ends - 1)]]
    shape = kind[data[starts]] + second * np.uint64(512) + kind[data[ends - 1]] * np.uint64(1 << 18) + np.minimum((ends - starts) // 4, 7).astype(np.uint64) * np.uint64(1 << 27) + same * np.uint64(1 << 30)
    pairs = mixed(shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:])[of[1:] == of[:-1]]
    places = np.concatenate((mixed(shape), pairs)) >> np.uint64(64 - BITS)
    rows = np.concatenate((of, of[1:][of[1:] == of[:-1]]))
    return places.astype(np.int64), rows, np.maximum(2 * n - 1, 0)


def _vote_counts(docs: DataFrame, text: str) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PATTERNS, np.int64)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                found, n = patterns(part.column(text))
                sums += np.bincount(found[n > 0], minlength=PATTERNS)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["pattern", "n"])

    out = np.zeros(PATTERNS, np.int64)
    for row in docs.select(text).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect():
        out[row["pattern"]] = row["n"]
    return out


def fit(docs: DataFrame, how: Fitting | None = None, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Estimate the label model on all documents and train the scorer on a bounded sample."""
    how = how or Fitting()
    good, rates, share = label_model(_vote_counts(docs, text))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = sampled_rows(rows, how.most_rows, how.most_bytes)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray, float]] = []
        forget_tokens()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                votes, n = patterns(part.column("text"))
                places, of, total = features(part.column("text"))
                key, count = np.unique(of << BITS | places, return_counts=True)
                ends = np.searchsorted(key >> BITS, np.arange(len(n) + 1))
                for i in np.flatnonzero(n > 0):
                    x = slice(ends[i], ends[i + 1])
                    own.append((key[x] & ((1 << BITS) - 1), count[x] / total[i], float(good[votes[i]])))
        z, s = np.zeros(1 << BITS), np.zeros(1 << BITS)
        bz = bs = 0.0
        l1, l2 = how.l1 * len(own), how.l2 * len(own)
        for _ in range(how.epochs):
            for x, v, y in own:
                root = np.sqrt(s[x])
                w = np.where(np.abs(z[x]) > l1, (np.sign(z[x]) * l1 - z[x]) / ((how.beta + root) / how.alpha + l2), 0.0)
                base = -bz * how.alpha / (how.beta + bs**0.5)
                d = 1 / (1 + np.exp(-np.clip(10 * (v @ w) + base, -35, 35))) - y
                g = 10 * d * v
                z[x] += g - (np.sqrt(s[x] + g * g) - root) / how.alpha * w
                s[x] += g * g
                bz += d - ((bs + d * d) ** 0.5 - bs**0.5) / how.alpha * base
                bs += d * d
        w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((how.beta + np.sqrt(s)) / how.alpha + l2), 0.0)
        places = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(10 * w[places], -bz * how.alpha / (how.beta + bs**0.5)))], names=["place", "weight"])

    made = chosen.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "text").mapInArrow(learn, "place long, weight double").toPandas()
    base = made["place"] < 0
    weights = np.zeros(1 << BITS)
    weights[made["place"][~base].to_numpy()] = made["weight"][~base].to_numpy()
    return Model(good, weights, float(made["weight"][base].iloc[0]) if base.any() else -40.0, rates, share)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score", weak: str = "weak_label", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the scorer's probability of good and the label model's added; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.good, model.weights, model.bias))

    def work(texts: pa.Array) -> list[np.ndarray]:
        good, weights, bias = sent.value
        votes, n = patterns(texts)
        places, of, total = features(texts)
        sums = np.bincount(of, weights[places], minlength=len(n)) / np.maximum(total, 1)
        p = 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))
        return [np.where(n > 0, p, 0.0), np.where(n > 0, good[votes], 0.0)]

    return with_text_columns(docs, text, {score: T.DoubleType(), weak: T.DoubleType()}, work, keep)
