import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tableops.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def plain_hash(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([plain_hash(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_siblings(levels, at):
    found = []
    for level in levels[:-1]:
        found.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else ""))
        at //= 2
    return found


def plain(docs):
    """The contract, in one process: a dictionary from row number to the result's columns."""
    leaf = [plain_hash(*[plain_field(v) for v in d]) for d in docs]
    forged = [leaf[i] if d[0] is None or d[3] is None or zlib.crc32(str(d[0]).encode()) % 7 else plain_hash(*[plain_field(v) for v in (*d[:3], d[3] + 1, d[4])]) for i, d in enumerate(docs)]
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((i for i, d in enumerate(docs) if d[2] == x), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, leaf[i])) for x in langs}
    trees = {x: plain_levels([leaf[i] for i in groups[x]]) for x in langs}
    top = plain_levels([trees[x][-1][0] for x in langs])
    out = []
    for number, x in enumerate(langs):
        for at, i in enumerate(groups[x]):
            path = plain_siblings(trees[x], at) + plain_siblings(top, number)
            node = forged[i]
            for right, other in path:
                node = plain_hash(other, node) if right else plain_hash(node, other)
            out.append((docs[i][0], leaf[i], trees[x][-1][0], top[-1][0], plain_hash(*[o for _, o in path]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def ours(spark, docs, extra=None):
    df = spark.createDataFrame(docs, SCHEMA)
    df = df.withColumns(extra) if extra else df
    return sorted((tuple(r) for r in manifest.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, {"n_chars": F.col("n_chars") + 1}, FIELDS).collect()), key=repr)


def made(n, langs):
    return [(i * 3 % 1009, f"s{i % 3}", langs[i * i % len(langs)], len(f"t {i}"), f"t {i}") for i in range(n)]


@pytest.mark.parametrize(("bits", "n"), [(1, 9), (2, 37), (10, 37), (10, 1)])
def test_equals_the_plain_tree(spark, monkeypatch, bits, n):
    monkeypatch.setattr(manifest, "BITS", bits)
    docs = made(n, ["en", "de", "é", "zz", "en", "en"])
    found = ours(spark, docs)
    assert found == plain(docs)
    assert all(v == (f == r) for *_, r, _, f, v in found)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BITS", 2)
    docs = [
        (7, "a", None, 3, "abc"),
        (7, "a", None, 3, "abc"),
        (7, "a", None, 4, "abcd"),
        (None, None, "en", None, None),
        (None, "", "en", 0, ""),
        (14, "", "", 0, ""),
        (21, "b", "en", None, "x" * 300_000),
        *[(5, "hot", "en", 2, "ab")] * 9,
    ]
    assert ours(spark, docs, {c: F.lit("clash") for c in ("of", "pos", "hash", "leaf", "part", "root", "path")}) == plain(docs)


def test_every_tampered_row_is_found(spark):
    docs = made(300, ["en", "de"])
    found = {r[0]: r for r in ours(spark, docs)}
    bad = {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 7 == 0}
    assert bad and {i for i, r in found.items() if not r[6]} == bad
    assert len({r[5] for i, r in found.items() if i in bad}) == len(bad), "each version has a root of its own"


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_versions_share_what_they_do_not_copy():
    tree = manifest.Tree([plain_hash(str(i)) for i in range(11)], alone=True)
    before, root = list(tree.hash), tree.root
    versions = [tree.changed(at, plain_hash("new", str(at))) for at in range(11)]
    assert tree.hash[: len(before)] == before and tree.root == root
    assert len(tree.hash) == len(before) + 11 * (tree.height + 1), "only ancestors are copied"
    for at, version in enumerate(versions):
        leaves = [plain_hash("new", str(i)) if i == at else plain_hash(str(i)) for i in range(11)]
        assert tree.hash[version] == plain_levels(leaves)[-1][0]
