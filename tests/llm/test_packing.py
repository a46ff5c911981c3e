import json
import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest

from tableops.llm import packing, token_files
from tableops.llm.tokens import _encoder, _for_words, encoder, separable
from tableops.plans.scratch import scratch_path

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
WORD = Path(public.path("word_bpe_49k.json")).read_text()
ODD = ["", "a b c\u0085d", "x\x1cy\x1dz", "a<|endoftext|>b", "it's I'LL 's", "é ́a", "ΑΣ ΣΑΣ", "İi İİ", "z　w", "don't \n\t 12.5 !!?? -- a,b. A,.", "ﬁ ½", "a ̀b", "Hello, WORLD. Été!"]


def plain_ids(text, end):
    return [*tokenizers.Tokenizer.from_str(WORD).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_whole_text(name):
    made = Path(public.path(name)).read_text()
    plain = tokenizers.Tokenizer.from_str(made)
    texts = [*ODD, " ".join(ODD * 3)]
    for text, ids in zip(texts, encoder(made)(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert separable(WORD) and not separable(Path(public.path("byte_bpe_50k.json")).read_text())


def test_plans_place_everything_once_and_fill_well():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice((1, 7, 30, 100))
        counts = {rng.randint(1, capacity): rng.choice((1, 2, 3, 50, 10**9)) for _ in range(rng.randrange(1, 12))}
        runs = packing.plan(counts, capacity)
        for length, n in counts.items():
            own = sorted(r for r in runs if r[0] == length)
            assert own[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:], strict=False)) and own[-1][1] + own[-1][2] == n
        edges = sorted({x for r in runs for x in (r[3], r[3] + r[2])})
        for first in edges[:-1]:  # the runs of a sequence, the same up to the next edge
            inside = sorted((r[4], r[0]) for r in runs if r[3] <= first < r[3] + r[2])
            end = 0
            for offset, length in inside:
                assert offset == end
                end += length
            assert 0 < end <= capacity
            assert sum(3 * length > capacity for _, length in inside) <= 2


def test_packed_documents(spark):
    texts = [*ODD, None, "word " * 700, "word " * 90, "word " * 90]
    frame = spark.createDataFrame([(i if i != 3 else None, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, rank string")
    placed = packing.packed_documents(frame, WORD, end_id=1, capacity=100, with_ids=True)
    found = placed.collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) and r["start"] == 100 * r["piece"]
    for i, text in enumerate(texts):
        ids = [x for r in sorted(by_doc[i if i != 3 else None], key=lambda r: r["piece"]) for x in r["ids"]]
        assert ids == plain_ids(text, 1)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 100
    whole = packing.sequences(placed).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in found) and all(sum(r["lengths"]) == len(r["ids"]) for r in whole)
    assert packing.packed_documents(frame.limit(0), WORD, end_id=1).count() == 0


def test_token_files_round_trip(spark):
    texts = [*ODD, None, "word " * 300]
    ids = [3 * i % 17 for i in range(len(texts))]
    data = [(i, t, 0) for i, t in zip(ids, texts, strict=True)] + [(ids[0], texts[0], 0), (None, "none", 0)]
    frame = spark.createDataFrame(data, "doc_id long, text string, part int")
    path = scratch_path(spark, "token-test")
    token_files.write(frame, path, WORD, end_id=2, parts=3)
    found = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [r[0] for r in want]
    start = 0
    for r in found:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert list(r["ids"]) in [plain_ids(t, 2) for i, t, _ in data if i == r["doc_id"]]
        start += r["n_tokens"]
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.checked(token_files.read(spark, path)).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in found}
    empty = scratch_path(spark, "token-test")
    token_files.write(frame.limit(0), empty, WORD, end_id=2, parts=2)
    assert token_files.read(spark, empty).count() == 0


#: Letters that change or compose in small letters, marks at the ends of words, added tokens in both cases.
BESIDE = [
    "the", "The", "it's", "DOGS'", "rock'.", "a...", "x&&&", "y.%%%", "_", "w_", "İstanbul", "H\u0331x", "H\u0331.", "STRASSE.", "ΣΑΣ", "σας.", "É&&&",
    "日本語.", "ПРИВЕТ!", "1a.", "²x².", "Ⅷ.", "Ⓐ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>.", "x<|endoftext|>y", "a=\u0338", "\u0338",
    "\xa0", "\x85", "\x1c", "ǅ", "ŉ.", "ª.", "á.", "\u212a", "ﬁ", "we'LL.", "a—.", "a.b.", "http://x.y/z?q=1.", "😀.", "\u0345", "", "~",
]


def test_odd_pieces_side_by_side():
    """The ids are those of the whole text, whatever stands beside a piece and however little is remembered."""
    plain, picked = tokenizers.Tokenizer.from_str(WORD), random.Random(7)
    texts = ["".join(picked.choice(BESIDE) + picked.choice(["", " ", " ", "\n"]) for _ in range(picked.randrange(30))) for _ in range(3000)]
    encode = encoder(WORD, 200)
    for i in range(0, len(texts), 5):
        for text, ids in zip(texts[i : i + 5], encode(texts[i : i + 5]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_encoded_without_the_steps_that_leave_them_alone():
    made = json.loads(WORD)
    words = tokenizers.Tokenizer.from_str(_for_words(made))
    assert words.normalizer is None
    assert words.encode("small straße").ids == tokenizers.Tokenizer.from_str(WORD).encode("Small STRA\xdfE", add_special_tokens=False).ids
    steps = [s for s in made["normalizer"]["normalizers"] if s["type"] != "Lowercase"]
    assert _for_words(made | {"normalizer": {"type": "Sequence", "normalizers": steps}}) is None


def test_white_space_of_all_kinds_and_long_pieces():
    """The ids are those of the whole text, also for pieces too long to be remembered."""
    plain, encode = tokenizers.Tokenizer.from_str(WORD), encoder(WORD, 20)
    blanks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2009", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff"]
    texts = [f"{b}word.{b}{b}\u00e9t\u00e9,{b}Two" for b in blanks] + ["a" * 3000 + ".", "\u65e5\u672c" * 500, "STRASSE" * 100 + "!", "\u00e9" * 300 + "??", " ", "."]
    for _ in range(2):
        for text, ids in zip(texts, encode(texts), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_common_words_stay_remembered(monkeypatch):
    """Making room keeps the words of the texts at hand, and a word is asked for once, whatever marks follow it."""
    asked, real = [], tokenizers.Tokenizer

    class Counted:
        def __init__(self, made):
            self.made = made

        @classmethod
        def from_str(cls, made):
            return cls(real.from_str(made))

        def __getattr__(self, name):
            return getattr(self.made, name)

        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split())
            return self.made.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encode = _encoder(WORD, 40)
    names = ["".join(chr(97 + int(d)) for d in str(n)) for n in range(1000, 1400)]
    texts = [" ".join(["common", "common,", "common."] + names[i : i + 10]) for i in range(0, 400, 10)]
    plain = real.from_str(WORD)
    assert [ids.tolist() for text in texts for ids in encode([text])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count("common") == asked.count(",") == asked.count(".") == 1


def test_words_at_hand_are_no_python_objects():
    """A text of 4 MB takes 60 MB of Python's memory at most (90 with a string for each word)."""
    text = "to be or not " * (4 * 2**20 // 13)
    encode = _encoder(WORD, 1000)
    list(encode(["to be or not"]))
    tracemalloc.start()
    (ids,) = encode([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == 4 * (4 * 2**20 // 13) and most < 60 << 20
