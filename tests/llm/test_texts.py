import random
import re

import numpy as np
import pyarrow as pa

from tableops.llm.texts import MARKS, distinct, flat, ngrams, slices, words

TEXTS = ["The cat\tsat", "", "the  CAT sat ", None, "é à b\nThe", "x" * 2_000_000 + " the", "the\x0bcat"]


def split(text, between):
    return [w for w in re.split("[" + re.escape(between.decode()) + "]+", text or "") if w]


def test_words_are_the_same_where_their_small_letters_are():
    for between in (b" \t\n\x0b\x0c\r", MARKS):
        hashes, at = words(*flat(pa.array(TEXTS)), between)
        low = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in split(t, between)] for t in TEXTS]
        assert [len(x) for x in low] == np.diff(at).tolist()
        seen = {}
        for word, h in zip([w for x in low for w in x], hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_rows_of_a_slice():
    whole = pa.array(TEXTS)
    for a in range(len(TEXTS)):
        part, _ = words(*flat(whole.slice(a, 2)))
        alone, _ = words(*flat(pa.array(TEXTS[a : a + 2])))
        assert part.tolist() == alone.tolist()


def test_ngrams_stay_within_rows():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(50)]
    hashes, at = words(*flat(pa.array(texts)))
    for gaps in ((0, 1), (0, 2), (0, 1, 2, 3)):
        found, rows = ngrams(hashes, at, gaps, 7)
        plain = [(r, tuple(w[i + g] for g in gaps)) for r, w in enumerate(t.split() for t in texts) for i in range(len(w) - gaps[-1])]
        assert rows.tolist() == [r for r, _ in plain]
        pairs = set(zip(found.tolist(), [g for _, g in plain], strict=True))
        assert len(pairs) == len({h for h, _ in pairs}) == len({g for _, g in pairs})


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(range(len(TEXTS)))], names=["t", "i"])
    parts = list(slices(batch, "t", 10))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(TEXTS)))
    assert distinct(np.array([3, 1, 3])).tolist() == [1, 3]
