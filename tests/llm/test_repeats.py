import random
from collections import Counter
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest

from tableops.llm import repeats


def plain(docs, length=repeats.LENGTH):
    """The contract with every string of every text in one dictionary."""
    texts = [(key, (text or "").encode()) for key, text in docs]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for key, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((key, len(t), int(gone.sum()), spans, sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ours(spark, docs, **options):
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in docs], "doc_id long, text string, core string, id int").repartition(3)
    return sorted((tuple(r) for r in repeats.without_repeats(df, **options).collect()), key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(n))


def corpus(seed):
    """Prose with copies, near copies, shared passages of about the length, runs, periods and letters of several bytes."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(5, 200)) for _ in range(25)]
    passages = [words(rng, 80)[: rng.choice((199, 200, 201, 230, 400))] for _ in range(6)]
    for passage in passages:
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(texts))
            at = rng.randrange(len(texts[i]) + 1)
            texts[i] = texts[i][:at] + passage[rng.choice((0, 0, 1, 7)) :] + texts[i][at:]
    for _ in range(6):
        copy = list(rng.choice(texts))
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = rng.choice("xyzé日")
        texts.append("".join(copy))
    texts += ["a" * rng.randint(150, 700), "a" * 300 + words(rng, 50), "ab" * 200, "abc" * 90 + "x", ("日本" * 60) + words(rng, 20) + ("日本" * 60)]
    texts += [words(rng, 3) + texts[0][40:300] + words(rng, 3)]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    expected = plain(docs)
    assert sum(r[2] for r in expected) and ours(spark, docs) == expected


def test_common_core_in_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", 3)
    rng = random.Random(9)
    line = words(rng, 60)[:190]
    docs = [(i, words(rng, 20) + line + words(rng, 20)) for i in range(30)] + [(99, words(rng, 10) + line + words(random.Random(1), 9)), (98, words(rng, 10) + line + words(random.Random(1), 9))]
    assert ours(spark, docs) == plain(docs)


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    docs = corpus(5)
    docs += [(100, " ".join(t for _, t in docs[:20])), (101, "z" * 5000)]
    assert ours(spark, docs) == plain(docs)


def test_odd_rows(spark):
    text = words(random.Random(3), 100)
    docs = [(1, None), (2, ""), (3, "short"), (None, text), (None, text + " and more"), (4, text), (4, text), (4, text[:250]), (5, text[:199]), (6, "\x00" * 450), (7, "\x00" * 199)]
    assert ours(spark, docs) == plain(docs)
    assert ours(spark, []) == []
    assert ours(spark, [(1, text)]) == plain([(1, text)])


def test_spans_and_bytes(spark):
    text = words(random.Random(4), 100)
    (_, _, removed, n, digest, spans, kept), *_ = ours(spark, [(1, "left " + text + " right"), (2, "other " + text)], with_bytes=True)
    assert n == len(spans) == 1 and spans[0]["end"] - spans[0]["start"] == removed >= len(text)
    assert sha256(bytes(kept)).hexdigest() == digest and bytes(kept).startswith(b"left") and bytes(kept).endswith(b"right")


def test_phrases_depend_on_trigger_strings_alone():
    data = np.frombuffer(words(random.Random(6), 400).encode(), np.uint8)
    found = set(repeats.triggers(data).tolist())
    assert len(data) / 70 < len(found) < len(data) / 30
    for t in found:
        assert repeats.triggers(data[t : t + repeats.TRIGGER]).tolist() == [0]
    assert {t + 13 for t in repeats.triggers(data[13:])} == {t for t in found if t >= 13}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert ours(spark, docs) == plain(docs)
