"""Language: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, every run of characters that are not letters becomes one space, and its
character 2- and 3-grams are hashed into 2^18 places. A feature's value is its share of the
text's n-grams times its inverse document frequency, counted over all documents that may be
learned from. The weights of each language are trained by follow-the-regularised-leader with
elastic-net penalties on a bounded sample (at most ``most_rows`` different rows of up to ``most_bytes``, those with
the smallest hashes); a temperature is then fitted on a fifth of that sample that the weights never saw, on
whole texts and on short cuts of them.

The likeliest language is one of those learned, whatever the text. So its probability is multiplied by
the share of the text's n-grams that are *familiar*, that is, found in at least ``FAMILIAR`` of the documents
that may be learned from: text in another script or language, code and random letters score low.

Since values are shares, the scoring tasks need one table of idf times weight: a text's logits
are a mean over its n-grams, whole text, however long.

Defined results: a missing text, or one without a letter, is ``und`` with score 0. Rows without
a language or a text teach nothing. Documents with the same id are judged one by one, and equal rows teach
once. With nothing to learn from, every text is ``und``. Ties go to the language first in the alphabet. Further
columns are passed through; one with the name of a new column is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.llm.frames import forget_tokens, free_name, sampled_rows, small_batches, with_text_columns
from tableops.llm.texts import slices

BITS = 18
SIZES = (2, 3)
UNKNOWN = "und"
#: The share of the learning documents that hold a familiar n-gram, and how many at least.
FAMILIAR, LEAST = 0.002, 2
#: n-grams of a short cut.
CUT = 40


@dataclass(frozen=True)
class Fitting:
    """Parameters of a fit; ``l1`` and ``l2`` count per training row."""

    most_rows: int = 8_192
    most_bytes: int = 1 << 20
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-5
    l2: float = 1e-5


@dataclass(frozen=True)
class Model:
    """``table`` holds, for each place, idf times weight of each language; ``familiar`` which places are."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    familiar: np.ndarray


def _is_letter() -> np.ndarray:
    """For each code point below 2^16, whether it is a letter; the rest are looked up in ``letters``."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def grams(texts: pa.Array, letters: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each n-gram size the places and the texts they are in; and how many letters each text has."""
    texts = pc.utf8_lower(texts.fill_null(""))
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(texts.to_pylist())
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        letter[i] = chr(codes[i]).isalpha()
    rows = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    counts = np.bincount(rows[letter], minlength=len(lengths))
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1]
    keep = letter | after | first  # of a run of others only its first character, as a space
    chars = np.where(letter, codes, 32).astype(np.uint32)[keep]
    rows = rows[keep]
    places, of = [], []
    for size in SIZES:
        if len(chars) < size:
            places.append(np.zeros(0, np.int32))
            of.append(np.zeros(0, np.int32))
            continue
        h = np.full(len(chars) - size + 1, size, np.uint32)
        for k in range(size):
            h = (h ^ chars[k : len(chars) - size + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        same = rows[: len(h)] == rows[size - 1 :]
        places.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32)[same])
        of.append(rows[: len(h)][same])
    return places, of, counts


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each place occurs, and of how many; over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen, total = _is_letter(), np.zeros(1 << BITS, np.int64), 0
        here = np.zeros(1 << BITS, bool)
        forget_tokens()
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                places, of, n = grams(part.column(text), letters)
                total += int((n > 0).sum())
                ends = [np.searchsorted(x, np.arange(len(n) + 1)) for x in of]
                for i in range(len(n)):
                    for p, e in zip(places, ends, strict=True):
                        here[p[e[i] : e[i + 1]]] = True
                    found = np.flatnonzero(here)
                    seen[found] += 1
                    here[found] = False
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(seen[found], total))], names=["place", "n"])

    made = docs.select(text).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    kept = made[made["place"] >= 0]
    out[kept["place"].to_numpy()] = kept["n"].to_numpy()
    return out, int(made.loc[made["place"] < 0, "n"].sum())


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature at which held-back rows are likeliest: a search over a fine grid of powers."""
    if not len(truth):
        return 1.0
    best, at = np.inf, 1.0
    for t in np.exp(np.linspace(-3, 3, 121)):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(truth)), truth]).mean())
        if loss < best:
            best, at = loss, float(t)
    return at


def descend(rows: list[tuple[np.ndarray, np.ndarray]], cuts: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, classes: int, how: Fitting) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, biases and temperature from rows of (places, values) and from a short cut of each."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bz, bn = np.zeros(classes), np.zeros(classes)
    fitted = [i for i in range(len(rows)) if i % 5 or len(rows) < 10]
    l1, l2 = how.l1 * len(rows), how.l2 * len(rows)

    def weights(z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((how.beta + root) / how.alpha + l2), 0.0)

    for _ in range(how.epochs):
        for i in fitted:
            x, v = rows[i]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w, base = weights(zx, root), -bz * how.alpha / (how.beta + np.sqrt(bn))
            logits = v @ w + base
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[truth[i]] -= 1
            g = v[:, None] * p
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / how.alpha * w
            n[x] = nx + g * g
            bz += p - (np.sqrt(bn + p * p) - np.sqrt(bn)) / how.alpha * base
            bn += p * p
    w, base = weights(z, np.sqrt(n)), -bz * how.alpha / (how.beta + np.sqrt(bn))
    held = [i for i in range(len(rows)) if i not in set(fitted)] if len(rows) < 10 else list(range(0, len(rows), 5))
    logits = np.array([v @ w[x] + base for i in held for x, v in (rows[i], cuts[i])]).reshape(-1, classes)
    return w, base, _temperature(logits, np.repeat(truth[held], 2))


def fit(docs: DataFrame, how: Fitting | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows of ``docs`` that have a text and a language: the counts from all, the weights from a sample."""
    how = how or Fitting()
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    nothing = Model([], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0, np.zeros(1 << BITS, bool))
    small_batches(docs.sparkSession)
    seen, total = document_frequencies(known)
    if not total:
        return nothing
    idf = np.log((1 + total) / (1 + seen)) + 1
    sent = docs.sparkSession.sparkContext.broadcast(idf)
    chosen = sampled_rows(known, how.most_rows, how.most_bytes)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, rows, cuts, names = _is_letter(), [], [], []
        forget_tokens()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                places, of, n = grams(part.column("text"), letters)
                ends = [np.searchsorted(x, np.arange(len(n) + 1)) for x in of]
                for i, name in enumerate(part.column("lang").to_pylist()):
                    each = [p[e[i] : e[i + 1]] for p, e in zip(places, ends, strict=True)]
                    for made, own in ((rows, np.concatenate(each)), (cuts, np.concatenate([p[: CUT // len(SIZES)] for p in each]))):
                        if n[i] and len(own):
                            x, count = np.unique(own, return_counts=True)
                            made.append((x, count / len(own) * sent.value[x]))
                    if n[i] and sum(map(len, each)):
                        names.append(name)
        languages = sorted(set(names))
        w, base, t = descend(rows, cuts, np.array([languages.index(x) for x in names], int), len(languages), how)
        for k, name in enumerate(languages):
            found = np.flatnonzero(w[:, k])
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(found) + 2)), pa.array(np.append(found, [-1, -2])), pa.array(np.append(w[found, k], [base[k], t]))], names=["lang", "place", "weight"])

    made = chosen.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "text").mapInArrow(learn, "lang string, place long, weight double").toPandas()
    languages = sorted(set(made["lang"]))
    if not languages:
        return nothing
    table, bias, temperature = np.zeros((1 << BITS, len(languages)), np.float32), np.zeros(len(languages)), 1.0
    for k, name in enumerate(languages):
        own = made[made["lang"] == name].set_index("place")["weight"]
        temperature, bias[k] = float(own[-2]), own[-1]
        own = own[own.index >= 0]
        table[own.index, k] = own.to_numpy() * idf[own.index]
    return Model(languages, table, bias, temperature, seen >= max(LEAST, FAMILIAR * total))


def predicted(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the likeliest language and its score added: its probability times the share of familiar n-grams.

    One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature, model.familiar))
    tables: list[np.ndarray] = []

    def work(texts: pa.Array) -> list:
        if not tables:
            tables.append(_is_letter())
        own = Model(*sent.value)
        places, of, n = grams(texts, tables[0])
        sums, total, familiar = np.zeros((len(n), len(own.bias))), np.zeros(len(n)), np.zeros(len(n))
        for p, rows in zip(places, of, strict=True):
            for k in range(len(own.bias)):
                sums[:, k] += np.bincount(rows, own.table[:, k][p], minlength=len(n))
            total += np.bincount(rows, minlength=len(n))
            familiar += np.bincount(rows, own.familiar[p], minlength=len(n))
        x = (sums / np.maximum(total, 1)[:, None] + own.bias) / own.temperature
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p *= (familiar / np.maximum(total, 1) / p.sum(axis=1))[:, None]
        best, known = p.argmax(axis=1), (n > 0) & bool(own.languages)
        names = np.array([*own.languages, UNKNOWN], object)
        return [pa.array(names[np.where(known, best, -1)], pa.string()), np.where(known, p[np.arange(len(n)), best], 0.0)]

    return with_text_columns(docs, text, {lang: T.StringType(), score: T.DoubleType()}, work, keep)


def of_languages(docs: DataFrame, model: Model, least: float = 0.5, languages: list[str] | None = None, text: str = "text") -> DataFrame:
    """The documents whose language is one of ``languages`` (any learned one by default) with a score of ``least``."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = predicted(docs, model, text, lang, score)
    wanted = F.col(lang).isin(model.languages if languages is None else languages)
    return found.where(wanted & (F.col(score) >= least)).drop(lang, score)
