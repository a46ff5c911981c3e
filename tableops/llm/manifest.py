"""A Merkle manifest of a table: a persistent binary tree over its rows, one subtree for each group.

A row's leaf is the SHA-256 of its fields. The leaves of a group, in order, are hashed two by two (a last
one without a partner alone) until one node remains, the group's subroot; subroots are hashed up to one root.

The tree is never in one place. Leaves are numbered within their group by a range partitioning and the counts
of its parts, and cut into aligned blocks of ``2 ** BITS``; a task builds a block. The roots of the blocks
are the leaves of the next tier, and so on; what a block needs from above is the path of siblings from its
root to the top, a few dozen digests whatever the table's size.

Within a block the tree is persistent: nodes are never changed. A leaf that was tampered with makes a new
version, which copies the leaf's ancestors and shares every other node; its block root is carried on through
the path above, so each version ends in a root of its own beside the untampered one.

Defined results: a missing field is ``-`` and differs from an empty one. A missing group comes first and is
a group of its own; a missing id comes first in it and is never tampered with. Rows that repeat an id
are ordered by their leaves; equal rows are interchangeable, and each is a leaf. A group of one row has its
leaf as subroot, a table of one group the subroot as root. An empty table gives no rows. Further
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.frames import sent_if_small
from tableops.plans.scratch import written

#: Levels of the tree that one task builds at a time.
BITS = 10


def field(value: Column) -> Column:
    """A field as it is hashed: its length in UTF-8 bytes, a colon and its text; ``-`` if missing."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


class Tree:
    """A persistent binary tree of at most ``2 ** BITS`` leaves; ``changed`` gives a new version.

    ``alone`` says that the leaves are the whole group, so that hashing ends with one node;
    else the tree is part of a larger one and always ``BITS`` high.
    """

    def __init__(self, leaves: Sequence[str], alone: bool) -> None:
        self.hash, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        level, self.height = list(range(len(leaves))), 0
        while len(level) > 1 if alone else self.height < BITS:
            level = [self._node(level[i], level[i + 1] if i + 1 < len(level) else -1) for i in range(0, len(level), 2)]
            self.height += 1
        self.root = level[0]

    def _node(self, left: int, right: int) -> int:
        self.hash.append(sha256((self.hash[left] + (self.hash[right] if right >= 0 else "")).encode()).hexdigest())
        self.left.append(left)
        self.right.append(right)
        return len(self.hash) - 1

    def _path(self, at: int) -> list[int]:
        """The nodes from the root down to a leaf."""
        path = [self.root]
        for level in reversed(range(self.height)):
            path.append(self.right[path[-1]] if at >> level & 1 else self.left[path[-1]])
        return path

    def siblings(self, at: int) -> list[str]:
        """For each level from the leaf up: the other node of its pair as L or R and the hash, or nothing."""
        found = []
        for level, parent in enumerate(reversed(self._path(at)[:-1])):
            own_right = at >> level & 1
            other = self.left[parent] if own_right else self.right[parent]
            found.append(("L" if own_right else "R") + self.hash[other] if other >= 0 else "")
        return found

    def changed(self, at: int, new: str) -> int:
        """The root of a version with another leaf: copies of its ancestors, all other nodes shared."""
        path = self._path(at)
        self.hash.append(new)
        self.left.append(-1)
        self.right.append(-1)
        node = len(self.hash) - 1
        for level, parent in enumerate(reversed(path[:-1])):
            node = self._node(self.left[parent], node) if at >> level & 1 else self._node(node, self.right[parent])
        return node


def folded(node: str, path: Sequence[str]) -> str:
    """The root that a node and the siblings above it lead to."""
    for other in path:
        pair = other[1:] + node if other[:1] == "L" else node + other[1:]
        node = sha256(pair.encode()).hexdigest()
    return node


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows``, a written table, with ``pos``, the place within the group (from 0), and ``n``, the group's size.

    The last column of ``order`` tells equal rows apart, so that no row is too frequent to be divided.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    at = rows.columns.index(group)
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, place = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            places = []
            for value in batch.column(at).to_pylist():
                if (value,) != last:
                    last, place = (value,), 0
                places.append(place)
                place += 1
            made = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(count, schema), "placed")
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(group, "part").agg(F.count("*").alias("rows"))
    parts = parts.select(F.col(group).alias("in_group"), F.col("part").alias("in_part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    parts = sent_if_small(written(parts, "parts"))  # a row for each part, and one more for each group
    found = placed.join(parts, placed[group].eqNullSafe(parts["in_group"]) & (placed["part"] == parts["in_part"]))
    return found.withColumn("pos", F.col("place") + F.col("before")).drop("in_group", "part", "in_part", "place", "before")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (of, pos, n, hash) with the block each is in and its place there."""
    return nodes.withColumns({"block": F.shiftright("pos", BITS), "at": F.col("pos").bitwiseAND((1 << BITS) - 1).cast("int")})


def _roots(nodes: DataFrame) -> DataFrame:
    """The next tier: the root of each block of nodes."""

    def build(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at").to_pydict()
        tree = Tree(rows["hash"], rows["n"][0] <= 1 << BITS)
        n = (rows["n"][0] + (1 << BITS) - 1) >> BITS
        return pa.table({"of": pa.array([rows["of"][0]], table.schema.field("of").type), "pos": pa.array([rows["block"][0]], pa.int64()), "n": pa.array([n], pa.int64()), "hash": pa.array([tree.hash[tree.root]], pa.string())})

    kind = nodes.schema["of"].dataType.simpleString()
    made = _blocks(nodes.select("of", "pos", "n", "hash")).groupBy("of", "block").applyInArrow(build, f"of {kind}, pos long, n long, hash string")
    return written(made, "tier")


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The siblings from each node of a tier up to its group's root, and that root; ``above`` has them for the next tier."""

    def follow(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at").to_pydict()
        tree = Tree(rows["hash"], rows["n"][0] <= 1 << BITS)
        paths = [tree.siblings(at) + up for at, up in zip(rows["at"], rows["path"], strict=True)]
        return pa.table({"of": pa.array(rows["of"], table.schema.field("of").type), "pos": pa.array(rows["pos"], pa.int64()), "path": pa.array(paths, pa.list_(pa.string())), "root": pa.array(rows["root"], pa.string())})

    kind = nodes.schema["of"].dataType.simpleString()
    made = _with_above(_blocks(nodes), above).groupBy("of", "block").applyInArrow(follow, f"of {kind}, pos long, path array<string>, root string")
    return written(made, "paths")


def _with_above(nodes: DataFrame, above: DataFrame) -> DataFrame:
    up = above.select(F.col("of").alias("up_of"), F.col("pos").alias("up_block"), "path", "root")
    return nodes.join(up, nodes["of"].eqNullSafe(up["up_of"]) & (nodes["block"] == up["up_block"])).drop("up_of", "up_block")


def block_paths(nodes: DataFrame) -> DataFrame:
    """For each block of the nodes (of, pos, n, hash): of, pos (its number), path and root of its group."""
    tiers = [_roots(nodes)]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tiers.append(_roots(tiers[-1]))
    paths = tiers[-1].select("of", "pos", F.array().cast("array<string>").alias("path"), F.col("hash").alias("root"))
    for tier in reversed(tiers[:-1]):
        paths = _paths(tier, paths)
    return paths


def manifest(docs: DataFrame, tampered: Column, changed: dict[str, Column], fields: Sequence[str], group: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are made of ``fields``; where ``tampered`` holds, a version is made with ``changed`` in place of
    the columns it names. ``proof_sha256`` is the hash of all siblings on the way up, ``folded_root``
    the root of the row's version, ``verified`` whether it is the root of the untampered table.
    """
    if BITS < 1:
        raise ValueError("a block has two leaves at least")
    forged = F.when(F.coalesce(tampered, F.lit(False)), leaf([changed.get(c, F.col(c)) for c in fields]))
    rows = docs.select(F.col(group).alias("of"), F.col(doc_id).alias("id"), leaf([F.col(c) for c in fields]).alias("hash"), forged.alias("forged"), F.monotonically_increasing_id().alias("salt"))
    leaves = written(numbered(written(rows, "leaves"), "of", ["id", "hash", "salt"]).drop("salt"), "numbered")
    paths = block_paths(leaves)
    tops = paths.groupBy("of").agg(F.first("root").alias("hash")).withColumns({"whole": F.lit(0), "salt": F.lit(0)})
    tops = written(numbered(written(tops, "subroots"), "whole", ["of", "hash", "salt"]), "tops")
    nodes = tops.select(F.col("whole").alias("of"), "pos", "n", "hash")
    upper = _paths(nodes, block_paths(nodes)).withColumnsRenamed({"path": "top_path", "root": "top"}).drop("of")
    upper = tops.select("of", "pos").join(upper, "pos").drop("pos").withColumnRenamed("of", "top_of")
    paths = written(paths.join(upper, paths["of"].eqNullSafe(upper["top_of"])).select("of", "pos", F.concat("path", "top_path").alias("path"), "root", "top"), "whole_paths")

    def prove(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at").to_pydict()
        tree, path = Tree(rows["hash"], rows["n"][0] <= 1 << BITS), rows["path"][0]
        out: dict[str, list] = {"proof_sha256": [], "folded_root": [], "verified": []}
        for at, new in zip(rows["at"], rows["forged"], strict=True):
            own = tree.siblings(at)
            version = folded(tree.hash[tree.changed(at, new)], path) if new else folded(rows["hash"][at], [*own, *path])
            out["proof_sha256"].append(sha256("".join(x[1:] for x in [*own, *path]).encode()).hexdigest())
            out["folded_root"].append(version)
            out["verified"].append(version == rows["top"][at])
        kept = {"doc_id": pa.array(rows["id"], table.schema.field("id").type), "leaf": pa.array(rows["hash"], pa.string()), "subroot": pa.array(rows["root"], pa.string()), "root": pa.array(rows["top"], pa.string())}
        return pa.table(kept | {c: pa.array(v, pa.bool_() if c == "verified" else pa.string()) for c, v in out.items()})

    kind = docs.schema[doc_id].dataType.simpleString()
    up = paths.select(F.col("of").alias("up_of"), F.col("pos").alias("up_block"), "path", "root", "top")
    nodes = _blocks(leaves)
    nodes = nodes.join(up, nodes["of"].eqNullSafe(up["up_of"]) & (nodes["block"] == up["up_block"])).drop("up_of", "up_block")
    return nodes.groupBy("of", "block").applyInArrow(prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
