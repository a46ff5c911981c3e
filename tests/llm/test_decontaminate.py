import random
import re
from collections import Counter

import pytest

from tableops.llm import decontaminate


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(docs, items, least=80):
    """(id, item, start) of the best window of each item in each document, by laying every item over every place."""
    words = {(i, tuple(w)) for i, t in items if len(w := plain_words(t)) >= 5}
    in_order = lambda w: [w[k : k + 5] for k in range(len(w) - 4)]
    used = Counter(s for w in {w for _, w in words} for s in set(in_order(w)))
    out = {}
    for key, text in docs:
        every = in_order(tuple(plain_words(text)))
        for item, own in words:
            count = Counter(in_order(own))
            for start in range(-len(own), len(every)):
                window = Counter(every[max(0, start) : max(0, start + len(own) - 4)])
                shared = window & count
                if not shared or not any(0 <= start + k < len(every) and every[start + k] == s for k, s in enumerate(in_order(own))):
                    continue
                weight = lambda c: sum(n * (1_000_000 // used[s]) for s, n in c.items())
                missing = count - shared
                strange = (window - shared).total() * weight(missing) // missing.total() if missing else 0
                if 100 * weight(shared) >= least * (weight(count) + strange):
                    like = weight(shared) / (weight(count) + strange)
                    out[key, item] = max(out.get((key, item), (0, 0)), (like, -max(0, start)))
    return {(k, i, -s) for (k, i), (_, s) in out.items()}


def test_items_that_stand_twice_lose_no_copy(spark):
    words = [f"w{i}" for i in range(54)]
    text, changed = " ".join(words), " ".join([*words[:27], "other", *words[28:]])
    shared = " ".join([*words[:50], "a", "b", "c", "d"])
    docs = spark.createDataFrame([(1, f"so much before {changed} and after"), (2, " ".join(words[:30]))], "doc_id long, text string")
    for items in ([(7, text)], [(7, text), (8, text)], [(7, text), (8, text), (9, text.upper())], [(7, text), (8, text), (9, shared)]):
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        got = {(r["id"], r["item"], r["start"]) for r in decontaminate.found(docs, benchmark).collect()}
        assert got >= {(1, i, 3) for i, t in items if t == text} and {k for k, _, _ in got} == {1}


def test_near_copies_at_every_similarity(spark):
    """A thousand passages with words changed, put in, left out, doubled; items repeat and share their beginnings."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(500))
    starts = [[word() for _ in range(12)] for _ in range(3)]
    items = [(i, " ".join(rng.choice(starts) * (i % 2) + [word() for _ in range(rng.choice((9, 18, 30, 54)))])) for i in range(20)]
    items += [(100 + i, items[i][1]) for i in range(0, 20, 3)]
    docs = []
    for i in range(1000):
        copy = rng.choice(items)[1].split()
        for _ in range(rng.randrange(3)):
            at, how = rng.choice((0, len(copy) // 2, len(copy) - 1, rng.randrange(len(copy)))), rng.randrange(4)
            copy[at : at + 1] = ([word()], [copy[at], word()], [], [copy[at]] * 2)[how]
        docs.append((i, " ".join([word() for _ in range(rng.randrange(9))] + copy + [word() for _ in range(rng.randrange(9))])))
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"], r["start"]) for r in decontaminate.found(frame, benchmark).collect()}
    assert got == plain(docs, items) and len(got) > 500


def test_places_are_those_of_all_windows(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    items = [(i, " ".join(word() for _ in range(rng.choice((5, 9, 24, 40))))) for i in range(12)]
    items += [(12, items[4][1] + " more words here"), (12, "again " * 9), (13, None), (14, "too few words"), (None, " ".join(word() for _ in range(20)))]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            copy = rng.choice(items[:13])[1].split()
            if i % 6 == 1 and len(copy) > 20:
                copy[-1] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in copy]
        docs.append((i, " ".join(w)))
    docs += [(60, None), (61, ""), (62, items[3][1]), (62, items[3][1]), (None, items[2][1]), (63, "again " * 300)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, start int")
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, weight int")
    got = {(r["id"], r["item"], r["start"]) for r in decontaminate.found(frame, benchmark).collect()}
    assert got == plain(docs, items)
    leaks = {k for k, _, _ in got}
    kept = decontaminate.without_leaks(frame, benchmark)
    assert kept.columns == frame.columns and sorted(kept.collect(), key=str) == sorted((r for r in frame.collect() if r["doc_id"] not in leaks), key=str)
    assert decontaminate.found(frame.limit(0), benchmark).count() == decontaminate.found(frame, benchmark.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    frame = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = decontaminate.found(frame, frame.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_blocks_miss_nothing_within_the_radius(spark):
    rng = random.Random(2)
    for radius in (3, 15):
        pairs = []
        for _ in range(200):
            x = rng.getrandbits(64)
            for b in rng.sample(range(64), rng.randrange(radius + 1)):
                pairs.append((x, x ^ 1 << b))
                x ^= 1 << b
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        frame = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
        cut = [frame.selectExpr(f"{c} as fingerprint").select(decontaminate._blocks(radius).alias("x")).collect() for c in "ab"]
        assert all(set(a["x"]) & set(b["x"]) and len(a["x"]) == radius + 1 for a, b in zip(*cut, strict=True))


@pytest.mark.parametrize("text", [None, "", "one", "a b c d", "A, b. C! d? e"])
def test_words_and_shingles(spark, text):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(decontaminate.words(F.col("t")).alias("w"), decontaminate.shingles(decontaminate.words(F.col("t"))).alias("s")).first()
    assert (row["w"] or []) == plain_words(text) and len(row["s"] or []) == max(0, len(plain_words(text)) - 4)
