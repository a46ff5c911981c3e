"""Token ids of whole texts by a public tokenizer file of the tokenizers library.

White space separates the pieces that the tokenizer treats on their own, so each distinct piece
is encoded once and looked up afterwards, which gives the ids of the whole text. Texts are taken in
small letters where the tokenizer does the same, and marks after a word are a piece of their own, so
there are fewer different pieces. They are split and counted as Arrow arrays. ``separable`` says whether a tokenizer file allows it; texts are encoded whole with any other file.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
import zlib
from collections.abc import Callable, Iterator
from types import ModuleType
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces a worker remembers; beyond, it keeps those of the texts at hand (ids don't depend on it).
REMEMBERED = 400_000
#: Characters and bytes of the longest pieces that are remembered; longer ones seldom come again.
_LONG, _LONG_BYTES = 64, 256
#: White space beyond ASCII that may stand between words.
_BLANKS = "\xa0\u2009\u202f\u3000"
#: Marks that are split from a letter before them.
_MARKS = string.punctuation
#: Pieces whose ids are put together at a time.
_GATHERED = 1 << 18
#: Pieces that are encoded at a time.
_LEARNED = 1 << 13
#: Small letters before U+0250, which are composed, and letters in all versions of Unicode.
_LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.islower())
#: A word of them.
_WORD = rf"\A[{_LATIN}]+\z"


def separable(tokenizer_json: str) -> bool:
    """Whether white space never is part of a token and what stands around it has no effect.

    True where normalisation is NFC, lower-casing or replacing white space, the first split drops
    all white space, and no added token holds any.
    """
    made = json.loads(tokenizer_json)
    norm = made.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = norm.get("normalizers", [norm])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    pre = made.get("pre_tokenizer") or {}
    first = pre.get("pretokenizers", [pre])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s" in str(first.get("pattern", {}).get("Regex"))
    added = made.get("added_tokens", [])
    return plain and drops and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)


def _for_words(made: dict) -> str | None:
    """The tokenizer file without the steps that leave small Latin words between blanks as they are; None if it may cut such words."""
    norm, pre = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
    steps, cuts = norm.get("normalizers", [norm]), pre.get("pretokenizers", [pre])
    letters = re.search(r"\|\[?\\p\{L\}\]?\+\|", str(cuts[0].get("pattern", {}).get("Regex")))
    if not letters or not any(s.get("type") == "Lowercase" for s in steps) or any(c["type"] != "ByteLevel" or c["use_regex"] or c["add_prefix_space"] for c in cuts[1:]):
        return None
    cuts = [{"type": "WhitespaceSplit"}, *cuts[1:]]
    return json.dumps(made | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": cuts}, "added_tokens": []})


def encoder(tokenizer_json: str, remembered: int = REMEMBERED) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """A function from texts to their ids (uint32 arrays), without special tokens.

    Tasks that a Python worker runs one after another share it, and what it remembers; functions
    are sent to workers by value, so it is kept under a name of its own.
    """
    kept = sys.modules.setdefault("_tableops_encoders", ModuleType("_tableops_encoders")).__dict__
    name = f"of_{zlib.crc32(tokenizer_json.encode())}_{len(tokenizer_json)}_{remembered}"
    if name not in kept:
        kept[name] = _encoder(tokenizer_json, remembered)
    return kept[name]


def _encoder(tokenizer_json: str, remembered: int) -> Callable[[list[str]], Iterator[np.ndarray]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Encoding, Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    if not separable(tokenizer_json):

        def whole(texts: list[str]) -> Iterator[np.ndarray]:
            for text in texts:
                yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

        return whole

    made = json.loads(tokenizer_json)
    plain = _for_words(made)
    quick = Tokenizer.from_str(plain) if plain else tokenizer
    added = [t["content"].lower() for t in made.get("added_tokens", [])]
    # An added token that begins with a letter could stand across the end of a word.
    ending = _MARKS if not any(t[:1].isalnum() for t in added) else ".,;:!?"
    end = np.zeros(tokenizer.get_vocab_size(), bool)
    suffix = made["model"].get("end_of_word_suffix") or ""
    end[[i for token, i in tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
    word = _WORD if plain else r"\A\z."  # the latter is none
    is_mark = np.zeros(256, bool)
    is_mark[list(ending.encode())] = True
    known: dict[str, bytes] = {}

    def encoded(tokenizer: Tokenizer, texts: list[str], most: int) -> Iterator[Encoding]:
        """What the tokenizer makes of the texts, ``most`` at a time, as it holds much more than ids."""
        for i in range(0, len(texts), most):
            yield from tokenizer.encode_batch_fast(texts[i : i + most], add_special_tokens=False)

    def ids_of(texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in encoded(tokenizer, texts, _LEARNED)]

    def learn_words(words: list[str], tokenizer: Tokenizer) -> None:
        """Words of letters in small letters, many at a time."""
        groups = [words[i : i + 512] for i in range(0, len(words), 512)]
        for group, found in zip(groups, encoded(tokenizer, [" ".join(g) for g in groups], _LEARNED // 512), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = (4 * np.flatnonzero(end[ids]) + 4).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                known.update(zip(group, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:  # a letter that is more than one when lower-cased, or no such suffix
                known.update(zip(group, ids_of(group), strict=True))

    def learn(new: pa.Array) -> None:
        """Encode new pieces: words of letters in small letters and without the marks after them."""
        low = pc.match_substring_regex(new, word)
        quickly = new.filter(low).to_pylist()
        split, cores, others = [], set(), set()
        for piece in new.filter(pc.invert(low)).to_pylist():
            core = piece.rstrip(ending)
            # Capital sigma has two small forms; what is not composed could change when it is.
            if len(piece) <= _LONG and core.isalpha() and (piece.isascii() or "\u03a3" not in piece and is_normalized("NFC", piece)):
                marks, core = piece[len(core) :], core.lower()
                if piece != core:
                    split.append((piece, core, marks))
                if core not in known:
                    cores.add(core)
                if marks and marks not in known:
                    others.add(marks)
            else:
                others.add(piece)
        learn_words(quickly, quick)
        learn_words(list(cores - known.keys()), tokenizer)
        others = list(others)
        known.update(zip(others, ids_of(others), strict=True))
        for piece, core, marks in split:
            known[piece] = known[core] + known[marks] if marks else known[core]

    def lowered(text: str) -> str:
        """The text, in small letters where the tokenizer makes them so, too."""
        if not text.isascii():
            for blank in _BLANKS:
                text = text.replace(blank, " ")
        if plain and (text.isascii() or "\u03a3" not in text and is_normalized("NFC", text)):
            low = text.lower()
            # What is not composed in small letters would be when they are encoded.
            if (low.isascii() or is_normalized("NFC", low)) and not any(t in low for t in added):
                return low
        return text

    def parted(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of the texts, one after another, and where each text's begin.

        Rare white space beyond ASCII stays within a piece, which the tokenizer splits itself.
        """
        split = pc.ascii_split_whitespace(pa.array([lowered(text) for text in texts], pa.large_string()))
        rows, words = split.offsets.to_numpy(), split.values
        _, bounds, data = words.buffers()
        if not plain or not data or not data.size:
            return words, rows
        # Marks after a word of small letters are a piece of their own.
        bounds = np.frombuffer(bounds, np.int64)[: len(words) + 1]
        marked = np.flatnonzero(is_mark[np.frombuffer(data, np.uint8)[bounds[1:] - 1]] & (bounds[1:] > bounds[:-1]))
        cores = pc.ascii_rtrim(words.take(pa.array(marked)), ending)
        low = pc.match_substring_regex(cores, word).to_numpy(zero_copy_only=False)
        marked, cut = marked[low], pc.binary_length(cores).to_numpy()[low]
        rows = rows + np.searchsorted(marked, rows)
        bounds = np.insert(bounds, marked + 1, bounds[marked] + cut)
        return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), data), rows

    def pieces(texts: list[str]) -> Iterator[np.ndarray]:
        found, rows = parted(texts)
        found = found.dictionary_encode()
        used = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        raw = list(map(known.get, used))
        new = np.array([ids is None for ids in raw], bool)
        if new.any():
            if len(known) + 2 * int(new.sum()) > remembered:
                kept = {p: ids for p, ids in zip(used, raw, strict=True) if ids is not None}
                known.clear()
                known.update(kept)
            learn(found.dictionary.filter(pa.array(new)))
            raw = [known[p] if ids is None else ids for p, ids in zip(used, raw, strict=True)]
            for piece in found.dictionary.filter(pc.greater(pc.binary_length(found.dictionary), _LONG_BYTES)).to_pylist():
                known.pop(piece, None)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        starts, values, at = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), "<u4"), found.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[at])))
        ids = np.empty(ends[-1], "<u4")
        for i in range(0, len(at), _GATHERED):
            some, bounds = at[i : i + _GATHERED], ends[i : i + _GATHERED + 1]
            places = np.repeat(starts[some] - bounds[:-1], sizes[some]) + np.arange(bounds[0], bounds[-1])
            ids[bounds[0] : bounds[-1]] = values[places]
        bounds = ends[rows]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:b]

    return pieces


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow array of int lists."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
