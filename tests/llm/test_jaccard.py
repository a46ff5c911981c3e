import random
import re

import numpy as np
import pytest

from tableops.llm import jaccard
from tests.conftest import rows

SCHEMA = "doc_id long, text string, print string, n long"


def plain_sets(texts, size):
    out = []
    for text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def plain_groups(docs, rule):
    """(id, set size, smallest id that links reach) by comparing all pairs."""
    sets = plain_sets([t for _, t in docs], rule.size)
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common * rule.over >= rule.under * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [(docs[i][0], len(sets[i]), least.get(top(i))) for i in range(len(docs))]


def near_copies(seed, groups=12, most=9):
    """Texts in groups that differ by a few words, some at the border, and unrelated ones."""
    rng, docs = random.Random(seed), []
    line = [f"c{i}" for i in range(12)]
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(rng.choice((3, 6, 30, 120, 700)))]
        base[:0] = line * rng.randrange(2)
        for _ in range(rng.randrange(1, most)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(4, 85, 100)])
def test_groups_are_those_of_all_pairs(spark, rule):
    docs = near_copies(rule.size)
    found = jaccard.grouped(spark.createDataFrame([(i, t, "p", 1) for i, t in docs], SCHEMA), rule)
    assert rows(found.select("id", "n", "component")) == sorted(plain_groups(docs, rule), key=lambda r: [(v is None, str(v)) for v in r])


def test_links_are_those_of_all_pairs(spark):
    docs, rule = near_copies(9, groups=6), jaccard.Rule()
    pairs, members = jaccard.links(spark.createDataFrame([(i, t, "p", 1) for i, t in docs], SCHEMA), rule)
    sets = plain_sets([t for _, t in docs], rule.size)
    of = {r["id"]: r["class"] for r in members.collect()}
    want = {tuple(sorted((of[i], of[j]))) for i, _ in docs for j in range(i) if of[i] != of[j] and (c := len(sets[i] & sets[j])) and c * 100 >= 80 * len(sets[i] | sets[j])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (5, "one two"), (None, "one two three"), (7, "one two three"), (8, long), (9, long + " end"), (9, long + " end")]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], SCHEMA)
    found = jaccard.grouped(frame)
    assert rows(found.select("id", "n", "component")) == sorted(plain_groups(docs, jaccard.Rule()), key=lambda r: [(v is None, str(v)) for v in r])
    kept = [(r["doc_id"], (r["text"] or "")[:13]) for r in jaccard.without_near_copies(frame).collect()]
    assert sorted(kept, key=str) == sorted([(1, ""), (2, ""), (3, " \n "), (4, "one two"), (7, "one two three"), (8, long[:13])], key=str)
    assert jaccard.grouped(frame.limit(0)).count() == 0
    assert jaccard.without_near_copies(frame.limit(0)).columns == frame.columns


def test_every_link_shares_a_key():
    rng = np.random.default_rng(5)
    frequent = rng.random(1 << jaccard.CLASS_BITS) < 0.5
    for rule in (jaccard.Rule(), jaccard.Rule(4, 85, 100), jaccard.Rule(5, 51, 100)):
        for n in [*range(1, 30), 70, 81, 94, 95, 300, 379, 380, 1300]:
            x = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            cut = int(rng.integers(0, n - int(rule.least(np.array(n))) + 1))
            y = np.sort(rng.permutation(x)[: n - cut])
            if len(y) * rule.over >= n * rule.under:
                assert set(jaccard.keys(x, frequent, rule).tolist()) & set(jaccard.keys(y, frequent, rule).tolist())
                assert jaccard.may_link(jaccard.outline(x), jaccard.outline(y), rule, n, len(y))
    with pytest.raises(ValueError, match="similarity"):
        jaccard.Rule(5, 50, 100)
