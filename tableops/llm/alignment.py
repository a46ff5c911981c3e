"""Where two tokenizers cut the same text: common groups of their tokens, and how often ids end together.

A is a byte-level tokenizer of the tokenizers library, B a sentencepiece model that puts a space before the
text; both are compared over the bytes of space + text. Token ends come from the libraries themselves: A's
character offsets, and the spans of B's immutable proto, which this version of sentencepiece hands out as
``offset_mapping``. These are coarse where a token holds a part of a character: A's offsets then name the
whole character, and so do the spans of B's byte-fallback tokens. Such ends are refined with the tokens'
decoded bytes, and every token's bytes are held against the text it stands for.

Single spaces between other characters end tokens of both (``chunkable`` says whether they do for given
files), so a text is cut there, each distinct chunk is aligned once and remembered, and texts are put
together from chunks. Texts are encoded whole with files for which that does not hold.

Links, pairs of an A and a B token that end together, are counted over the whole corpus. Texts are read
once: a document's distinct pairs are kept in a table in the shared folder, and looked up among the counts
when these are known. The counts are one row for each pair of ids. They are sent to the tasks while they are at
most ``most_sent`` pairs, and joined with the documents' pairs beyond.

Defined results: a text that is missing or empty, or whose tokens do not give back its bytes (it holds U+2581,
say), has no tokens: zeros and an empty digest; it adds nothing to the counts. Rows that repeat an id are
rows of their own and count as often. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.texts import slices
from tableops.plans.scratch import written

#: Distinct chunks a worker remembers before it starts anew (results don't depend on it).
REMEMBERED = 600_000
#: Pairs of ids whose counts are sent to the tasks at most: 17 bytes each.
MOST_SENT = 4_000_000
SPACE = "▁"

_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_UNEVEN = re.compile(r"\s | \s|^ | $")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level tokenizers write bytes as: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def chunkable(tokenizer_json: str, pieces: list[str]) -> bool:
    """Whether a single space between other characters always begins a token of both tokenizers.

    True where A splits by its byte-level expression, changes nothing before and adds no token with a
    space, and no piece of B has a space after another character.
    """
    made = json.loads(tokenizer_json)
    pre = made.get("pre_tokenizer") or {}
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    added = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in made.get("added_tokens", []))
    return bool(level) and not made.get("normalizer") and not added and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)


class Aligner:
    """Aligns chunks of text, many at a time, and remembers them by number.

    ``known`` holds for each chunk the numbers of A's and B's tokens and of groups; ``good`` whether its tokens
    give its bytes; ``groups`` its digest text; ``links`` from ``starts`` on its linked pairs.
    """

    def __init__(self, tokenizer_json: str, model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(tokenizer_json)
        self.first.encode_special_tokens = True  # their strings in a text are ordinary text
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        vocabulary = self.first.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.fallback = np.array([bool(_BYTE_PIECE.fullmatch(p)) for p in pieces])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.fallback[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(pieces)))]
        self.whole = not chunkable(tokenizer_json, pieces)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.good, self.known = np.zeros(0, bool), np.zeros((0, 3), np.int64)
        self.groups: list[str] = []
        self.links = self.starts = np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        return _BETWEEN.split(text) if _UNEVEN.search(text) else text.split(" ")

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the chunks of each text; new ones are aligned first."""
        cut = [self.chunks(t) for t in texts]
        new = set().union(*cut) - self.number.keys()
        alone = [c for c in new if self.whole or not c or c != c.strip()]  # with others beside it, its spaces would be one run
        new = [*new.difference(alone), *alone]
        some = len(self.number)
        self.number.update(zip(new, range(some, some + len(new)), strict=True))
        self.good = np.concatenate([self.good, np.zeros(len(new), bool)])
        self.known = np.concatenate([self.known, np.zeros((len(new), 3), np.int64)])
        links, joined = [self.links], len(new) - len(alone)
        for at in [*range(0, joined, 512), *range(joined, len(new))]:
            self._learn(new[at : min(at + 512, joined) if at < joined else at + 1], some + at, links)
        self.links = np.concatenate(links)
        self.starts = np.cumsum(self.known[:, 2]) - self.known[:, 2]
        find = self.number.__getitem__
        return [np.fromiter(map(find, c), np.int64, len(c)) for c in cut]

    def linked(self, chunks: np.ndarray) -> np.ndarray:
        """The linked pairs of some chunks, one after another; a chunk has as many as groups."""
        n = self.known[chunks, 2]
        ends = np.cumsum(n)
        return self.links[np.repeat(self.starts[chunks] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn(self, new: list[str], number: int, links: list[np.ndarray]) -> None:
        text = " " + " ".join(new)
        data = text.encode()
        a = self.first.encode(text, add_special_tokens=False)
        b = self.second.encode(text[1:], return_type="offset_mapping") if text[1:] else {"ids": [], "offsets": []}
        a_ids, b_ids = np.array(a.ids, np.int64), np.array(b["ids"], np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a.ids)) != data or b"".join(map(self.b_bytes.__getitem__, b["ids"])) != data:
            if len(new) > 1:  # one of them is not given back
                for k, chunk in enumerate(new):
                    self._learn([chunk], number + k, links)
                return
            self.groups.append("")
            return
        byte_at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        spans = np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        a_ends = refined(byte_at[spans[:, 1]], np.append(spans[1:, 0] < spans[:-1, 1], False), self.a_sizes[a_ids])
        spans = np.fromiter(chain.from_iterable(b["offsets"]), np.int64, 2 * len(b_ids)).reshape(-1, 2) + 1  # after the space
        b_ends = refined(byte_at[spans[:, 1]], self.fallback[b_ids], self.b_sizes[b_ids])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_a, of_b = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
        ends = np.cumsum([len(c.encode()) + 1 for c in new])
        groups = np.searchsorted(common, ends, "right")
        if not np.array_equal(common[groups - 1], ends):
            raise ValueError("a chunk does not end with tokens of both")
        links.append(a_ids[of_a] << 32 | b_ids[of_b])
        rows = slice(number, number + len(new))
        self.good[rows] = True
        for column, found in enumerate((np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right"), groups)):
            self.known[rows, column] = np.diff(found, prepend=0)
        name = self.names.__getitem__
        first, second = list(map(name, a.ids)), list(map(name, b["ids"]))
        i, j, made = 0, 0, []
        for x, y in zip((of_a + 1).tolist(), (of_b + 1).tolist(), strict=True):
            made.append((first[i] if x - i == 1 else ",".join(first[i:x])) + "|" + (second[j] if y - j == 1 else ",".join(second[j:y])))
            i, j = x, y
        cuts = groups.tolist()
        self.groups += [";".join(made[x:y]) for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]


def refined(coarse: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end: as the library's spans say; for those that end inside a character, by their decoded bytes."""
    decoded = np.cumsum(sizes)
    ends = np.where(inside, decoded, coarse)
    if not np.array_equal(ends, decoded):
        raise ValueError("the span of a token is not where its bytes are")
    return ends


def aligner(tokenizer_json: str, model: bytes) -> Aligner:
    """The aligner that the tasks of a Python worker share."""
    kept = sys.modules.setdefault("_tableops_aligners", ModuleType("_tableops_aligners")).__dict__
    name = f"of_{zlib.crc32(tokenizer_json.encode())}_{zlib.crc32(model)}"
    if name not in kept:
        kept[name] = Aligner(tokenizer_json, model)
    return kept[name]


def digests(docs: DataFrame, tokenizer_json: str, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over all texts. A row for each document: doc_id, uid, its sizes and groups_sha256, and its links as ``pairs`` and
    ``times`` (sorted distinct pairs, each as the difference from the one before, and how often each stands
    there, as packed numbers); and rows that count links (``pair``, ``n``) for some documents together.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups"]
    schema = f"doc_id {kind}, uid long, {', '.join(f'{n} long' for n in names)}, groups_sha256 string, pairs binary, times binary, pair long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = aligner(tokenizer_json, model), np.zeros(0, np.int64)
        fields: list[pa.Field] = []

        def made(columns: dict[str, pa.Array]) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=pa.schema(fields))

        def counted() -> pa.RecordBatch:
            used = np.flatnonzero(seen)
            pairs, place = np.unique(own.linked(used), return_inverse=True)
            n = np.bincount(place, np.repeat(seen[used], own.known[used, 2]), minlength=len(pairs)).astype(np.int64)
            return made({"pair": pa.array(pairs), "n": pa.array(n)})

        for batch in batches:
            fields[:] = [pa.field("doc_id", batch.schema.field("doc_id").type), *[pa.field(n, pa.int64()) for n in ("uid", *names)], pa.field("groups_sha256", pa.string())]
            fields += [pa.field("pairs", pa.binary()), pa.field("times", pa.binary()), pa.field("pair", pa.int64()), pa.field("n", pa.int64())]
            for part in slices(batch, "text", 1 << 20):
                if len(own.good) > REMEMBERED:
                    if seen.any():
                        yield counted()
                    own.clear()
                    seen = np.zeros(0, np.int64)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = own.numbers(texts)
                good = [bool(t) and own.good[r].all() for t, r in zip(texts, rows, strict=True)]
                seen = np.concatenate([seen, np.zeros(len(own.good) - len(seen), np.int64)])
                if any(good):
                    seen += np.bincount(np.concatenate([r for r, g in zip(rows, good, strict=True) if g]), minlength=len(seen))
                sums, shas, pairs, times = np.zeros((len(rows), 3), np.int64), [], [], []
                for k, (row, fine) in enumerate(zip(rows, good, strict=True)):
                    shas.append(sha256(";".join(map(own.groups.__getitem__, row.tolist())).encode()).hexdigest() if fine else "")
                    found, n = np.unique(own.linked(row) if fine else own.links[:0], return_counts=True)
                    sums[k] = own.known[row].sum(axis=0) * fine
                    pairs.append(np.diff(found, prepend=0).astype("<i8").tobytes())
                    times.append(n.astype("<u4").tobytes())
                yield made({"doc_id": part.column("doc_id"), "uid": part.column("uid"), "groups_sha256": pa.array(shas, pa.string()), "pairs": pa.array(pairs, pa.binary()), "times": pa.array(times, pa.binary())} | {c: pa.array(sums[:, j]) for j, c in enumerate(names)})
        if seen.any():
            yield counted()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("uid"))
    return rows.mapInArrow(run, schema)


def unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(pairs, "<i8")), np.frombuffer(times, "<u4").astype(np.int64)


def aligned(docs: DataFrame, tokenizer_json: str, model: bytes, doc_id: str = "doc_id", text: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose pair is the most frequent one of its B id, ``count_sum`` adds up the
    frequencies of all links of the document. A group ends with one token of each, so it has one link.
    """
    found = written(digests(docs, tokenizer_json, model, doc_id, text), "alignments")
    counts = found.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))  # one row for each id of A at most
    counts = written(counts.withColumn("best", F.col("n") == best), "links")
    rows = found.where(F.col("uid").isNotNull()).drop("pair", "n")
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    last = ["doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"]
    kind = docs.schema[doc_id].dataType.simpleString()
    if counts.count() > most_sent:

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uid, *packed in zip(*[batch.column(c).to_pylist() for c in ("uid", "pairs", "times")], strict=True):
                    pairs, n = unpacked(*packed)
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(n), pa.int64()), pa.array(pairs, pa.int64()), pa.array(n)], names=["uid", "pair", "m"])

        pairs = rows.mapInArrow(distinct, "uid long, pair long, m long").join(counts, "pair")
        sums = pairs.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
        return rows.drop("pairs", "times").join(sums, "uid", "left").select(*last)

    table = counts.toPandas().sort_values("pair")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, top = sent.value
        for batch in batches:
            sums = np.zeros((batch.num_rows, 2), np.int64)
            for k, packed in enumerate(zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True)):
                pairs, times = unpacked(*packed)
                at = np.searchsorted(known, pairs)
                sums[k] = times[top[at]].sum(), times @ n[at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=[*names, "n_best", "count_sum"])

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"
    return rows.mapInArrow(look_up, schema).select(*last)
