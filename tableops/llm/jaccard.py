"""N-gram Jaccard join with token-combination prefixes.

Every text is a set of word shingles. Texts with the same set are one class, and only classes
are joined. Two sets link when ``over * intersection >= under * union`` (85 / 100 by default).

*Order.* Shingles are counted over all documents in 2^24 hash classes; a shingle whose class is
well above the mean is frequent. Sets are ordered rare shingles first, then frequent ones, by
hash among themselves.

*Parts.* The universe is cut by hash into 4^j parts, so that a set has some 20 to 80 shingles in
each. If two sets link, they do so within at least one part (the whole ratio is a weighted mean
of the parts' ratios). A set near the border of a size range is indexed for both ranges.

*Prefixes.* Of a part with n shingles, s = n - ceil(n * under / over) may be missing in a linked
set. Its first s + 1 shingles hold the first common one. Where that one can be frequent, the
prefix is extended by one shingle, and pairs of frequent shingles are indexed in place of single
ones: if the first common shingle is frequent, so is the second, and both are in the prefix.
Rare shingles are indexed alone. No link is lost, and the index stays in proportion to the text.

*Candidates.* The sets under one key are compared with two of them, those with the fewest rare
shingles, which joins almost every group of copies. What is still in different components afterwards is compared pair by pair, so the result is exact whatever the groups are:
under each key, the sets outside the component that has most sets there with all others. The parity of a
set's shingles over 512 bins keeps most of these pairs from being made: where two parities differ in
more bins than linked sets can differ in shingles, the sets don't link.

*Check.* A set's outline says how many of its shingles fall into each of about n bins. The sum of the
smaller counts of two outlines is at least their overlap, so pairs whose outlines rule out a link are
left out at little cost. The rest are compared on all shingles of both whole texts (64-bit hashes).

Defined results: a text that is missing, empty or white space has no shingle and links with
nothing, not even with another such text. With fewer words than a shingle has, the whole
sequence is the one shingle. Rows that repeat a document id are documents of their own; a
missing id never becomes a component's id unless all ids in it are missing. Other columns,
whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.frames import free_name, sent_if_small
from tableops.llm.texts import WHITE, distinct, flat, mixed, ngrams, slices, words
from tableops.plans.scratch import written

CLASS_BITS = 24
BLOCK_BITS = 16
#: Bits of the parity that tells sets apart in the last round.
PARITY_BITS = 512
#: Texts that no candidate pair needs are left out of the check by a filter of 2^22 bits.
MARK_BITS = 22
#: Shingles of a part that sizes aim at; sizes of parts are within a factor of two of it.
PART = 40


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; sets link at ``under / over`` or more."""

    size: int = 5
    under: int = 80
    over: int = 100

    def __post_init__(self) -> None:
        if not self.over < 2 * self.under <= 2 * self.over:
            raise ValueError("the least similarity has to be above one half, and 1 at most")

    def least(self, n: np.ndarray) -> np.ndarray:
        """The least overlap of a set of ``n`` with one that links to it."""
        return -(-n * self.under // self.over)

    def sized(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.over >= F.greatest(a, b) * self.under


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, at = words(*flat(texts), WHITE)
    shingles, rows = ngrams(hashes, at, tuple(range(size)), size)
    ends = np.searchsorted(rows, np.arange(len(at)))
    out = []
    for i in range(len(at) - 1):
        n = at[i + 1] - at[i]
        if 0 < n < size:  # the whole sequence
            out.append(ngrams(hashes[at[i] : at[i + 1]], np.array([0, n]), tuple(range(n)), n)[0])
        else:
            out.append(distinct(shingles[ends[i] : ends[i + 1]]))
    return out


def outline(x: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of n / 2 to n bins."""
    bins = 4
    while bins < len(x) / 2:
        bins *= 2
    counts = np.bincount((x >> np.uint64(CLASS_BITS)).astype(np.int64) & (bins - 1), minlength=bins)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() if counts.max() < 256 else b""


def parity(x: np.ndarray) -> list[int]:
    """For each of 512 bins whether an odd number of a set's shingles is in it, as eight 64-bit numbers."""
    odd = np.bincount((x >> np.uint64(CLASS_BITS)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def may_link(a: bytes, b: bytes, rule: Rule, n_a: int, n_b: int) -> bool:
    """Whether two sets can link, as far as their outlines tell."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    while len(x) > len(y):
        x = x.reshape(2, -1).sum(axis=0)
    while len(y) > len(x):
        y = y.reshape(2, -1).sum(axis=0)
    most = int(np.minimum(x, y).sum())
    return most * rule.over >= (n_a + n_b - most) * rule.under


def _part_bits(n: int) -> int:
    bits = 0
    while n >> bits > 2 * PART:
        bits += 2
    return bits


def keys(x: np.ndarray, is_frequent: np.ndarray, rule: Rule) -> np.ndarray:
    """Index keys of one set: single rare shingles and pairs of frequent ones, of each part's prefix."""
    n, out = len(x), []
    if not n:
        return x
    frequent = is_frequent[(x & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)]
    for bits in sorted({_part_bits(n), _part_bits(n * rule.over // rule.under)}):
        part = (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
        order = np.argsort(part * 2 + frequent, kind="stable")
        token, part, often = x[order], part[order], frequent[order]
        total = np.bincount(part, minlength=1 << bits)
        rare = total - np.bincount(part[often], minlength=1 << bits)
        first = np.cumsum(total) - total
        place = np.arange(n) - first[part]
        spare = total - rule.least(total)
        salt = np.uint64(mixed(np.array([bits + 1], np.uint64))[0])
        out.append(mixed(token[(place <= spare[part]) & (~often | (total[part] == 1))] ^ salt))
        pairs = np.maximum(spare + 2 - rare, 0) * (rare <= spare) * (total > 1)
        for m in np.unique(pairs[pairs > 1]):
            at = first[pairs == m] + rare[pairs == m]
            i, j = np.triu_indices(int(m), 1)
            out.append(mixed((token[at[:, None] + i] ^ salt) * np.uint64(0x9E3779B97F4A7C15) + token[at[:, None] + j]).ravel())
    return np.concatenate(out)


def _scan(docs: DataFrame, rule: Rule) -> DataFrame:
    """For each document its size and set key, and for each task its shingle counts by class, in blocks."""

    names = ["id", "print", "n", "set", "outline", "parity", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, np.uint16)  # 65,535 stands for more
        for batch in batches:
            for part in slices(batch, "text"):
                own = sets(part.column("text"), rule.size)
                seen, often = np.unique(np.concatenate(own) & np.uint64((1 << CLASS_BITS) - 1), return_counts=True)
                seen = seen.astype(np.int64)
                counts[seen] = np.minimum(counts[seen] + often, 65_535)
                spread = [(mixed(x), mixed(x ^ np.uint64(0x5DEECE66D))) for x in own]
                sums = [[int(s.sum()) & (2**64 - 1) for s in pair] for pair in spread]
                key = [b"".join(v.to_bytes(8, "little") for v in pair) for pair in sums]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("print"), pa.array([len(x) for x in own], pa.int64()), pa.array(key, pa.binary()), pa.array(map(outline, own), pa.binary()), pa.array(map(parity, own), pa.list_(pa.int64())), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())],
                    names=names,
                )
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        some = [i for i in range(len(blocks)) if blocks[i].any()]
        packed = [zlib.compress(blocks[i].astype("<u2").tobytes(), 1) for i in some]
        empty = pa.nulls(len(some), pa.int64())
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, none, none, pa.nulls(len(some), pa.list_(pa.int64())), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.mapInArrow(run, "id long, print long, n long, set binary, outline binary, parity array<long>, block int, counts binary")


def _frequent(scan: DataFrame) -> np.ndarray:
    """Which shingle classes are frequent: their counts over all tasks, summed a block at a time."""
    total = scan.where("block is null").agg(F.sum("n")).first()[0] or 0
    bound = 3 * total / (1 << CLASS_BITS) + 8

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(packed), "<u2").astype(np.int64)
                sums[block] = sums[block] + own if block in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(v > bound).tobytes() for v in sums.values()], pa.binary())], names=["block", "frequent"])

    blocks = 1 << (CLASS_BITS - BLOCK_BITS)
    out = np.zeros((blocks, 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in scan.where("block is not null").select("block", "counts").repartition(F.col("block")).mapInArrow(add, "block int, frequent binary").collect():
        out[row["block"]] = np.frombuffer(row["frequent"], np.uint8)
    return out.ravel()


def _indexed(docs: DataFrame, classes: DataFrame, frequent: np.ndarray, rule: Rule) -> DataFrame:
    """Keys of all classes: key, how common the set's rarest part is, size, class."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_frequent = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for part in slices(batch, "text"):
                own = sets(part.column("text"), rule.size)
                found = [keys(x, is_frequent, rule).view(np.int64) for x in own]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                rare = [int((~is_frequent[(x & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)]).mean() * 1000) if len(x) else 0 for x in own]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("print"), pa.array(rare, pa.int32()), lists], names=["id", "print", "rare", "keys"])

    made = docs.mapInArrow(run, "id long, print long, rare int, keys array<long>")
    own = classes.select("class", "n", F.col("first.id").alias("cid"), F.col("first.print").alias("cprint"))
    kept = made.join(own, F.col("id").eqNullSafe(F.col("cid")) & (F.col("print") == F.col("cprint")))
    return kept.select(F.explode("keys").alias("key"), "rare", F.col("n").cast("int").alias("n"), "class")


def _grouped(index: DataFrame) -> DataFrame:
    """All keys that several classes have: key, rank (from 0, fewest rare shingles first), class, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_before = class_before = held = None  # held: the first row of a key, until a second class is seen
        rank_before = 0
        for batch in batches:
            key, cls = batch.column("key").to_numpy(), batch.column("class").to_numpy()
            if not len(key):
                continue
            new = np.append(key[0] != key_before, key[1:] != key[:-1])
            repeat = ~new & np.append(cls[0] == class_before, cls[1:] == cls[:-1])
            if repeat.all():
                continue
            key, cls, n, new = key[~repeat], cls[~repeat], batch.column("n").to_numpy()[~repeat], new[~repeat]
            place = np.arange(len(key))
            start = np.maximum.accumulate(np.where(new, place, -1))
            rank = np.where(start >= 0, place - start, place + 1 + rank_before)
            rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(rank), pa.array(cls), pa.array(n)], names=["key", "rank", "class", "n"])
            if held is not None and not new[0]:
                yield held
            shared = (rank > 0) | np.append(~new[1:], False)
            if shared.any():
                yield rows.filter(pa.array(shared))
            key_before, class_before, rank_before = key[-1], cls[-1], int(rank[-1])
            held = rows.slice(len(key) - 1) if rank_before == 0 else None

    return index.repartition(F.col("key")).sortWithinPartitions("key", "rare", "class").mapInArrow(run, "key long, rank long, class long, n int")


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Of the pairs (a, b) of classes those that link, checked on outlines and then on whole texts."""
    outlines = classes.select("class", "n", F.col("first.outline").alias("outline"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("o_a", "o_b", "n_a", "n_b"))
            keep = [may_link(x, y, rule, n, m) for x, y, n, m in zip(*columns, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    right = pairs.join(outlines.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("outline").alias("o_b")), "b")
    both = right.join(outlines.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("outline").alias("o_a")), "a")
    pairs = written(both.select("a", "b", "n_a", "n_b", "o_a", "o_b").mapInArrow(compare, "a long, b long"), "near")
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    own = written(classes.join(wanted, "class").select("class", F.col("first.id").alias("cid"), F.col("first.print").alias("cprint")), "wanted")
    marks = np.zeros(1 << (MARK_BITS - 5), np.uint32)
    for row in own.select(F.expr(f"cprint & {(1 << MARK_BITS) - 1}").alias("place")).groupBy(F.expr("place >> 5").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 31 as int)))").alias("bits")).collect():
        marks[row["word"]] = row["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("print").to_numpy() & ((1 << MARK_BITS) - 1)
            yield batch.filter(pa.array((sent.value[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)).astype(bool)))

    texts = docs.mapInArrow(sift, docs.schema).join(own, F.col("id").eqNullSafe(F.col("cid")) & (F.col("print") == F.col("cprint")))
    texts = written(texts.dropDuplicates(["class"]).select("class", "text"), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, None
        for batch in batches:
            for part in slices(batch, "text_b"):
                a, b = part.column("a").to_pylist(), sets(part.column("text_b"), rule.size)
                keep = []
                for i, y in enumerate(b):
                    if a[i] != last or of is None:
                        last, of = a[i], sets(part.column("text_a").slice(i, 1), rule.size)[0]
                    common = len(of) + len(y) - len(distinct(np.concatenate((of, y))))
                    keep.append(common * rule.over >= (len(of) + len(y) - common) * rule.under)
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    right = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each node of ``links`` (a, b) is joined to: node, root.

    Alternating stars: each node's larger neighbours, then its smaller ones, are hung on the
    smallest node near it, until only stars are left. Neighbours are never gathered in a row.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now


@dataclass(frozen=True)
class Prepared:
    """The written tables that joins start from."""

    docs: DataFrame
    members: DataFrame
    classes: DataFrame
    groups: DataFrame
    rule: Rule


def prepare(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> Prepared:
    """Classes of equal sets, and the classes under each key of the index."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("print", F.xxhash64("id", "text"))
    scan = written(_scan(texts, rule), "scan")
    members = scan.where("block is null").select("id", "print", "n", "set", "outline", "parity")
    classes = members.where("n > 0").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print", "outline", "parity")).alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    groups = written(_grouped(_indexed(texts, classes, _frequent(scan), rule)), "groups")
    return Prepared(texts, members, classes, groups, rule)


def _apart(own: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """All pairs under a key that are in different components and may link: a, class.

    One of the two is always outside the component that has most of the key's sets.
    """
    most = own.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    own = own.join(most, "key").join(classes.select("class", F.col("first.parity").alias("parity")), "class")
    own = written(own.select("key", "class", "n", "root", "main", *[F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY_BITS // 64)]), "apart")
    outside = own.where("root <> main").select("key", *[F.col(c).alias(c + "_a") for c in own.columns if c not in ("key", "main")])
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_a"))) for i in range(PARITY_BITS // 64)), F.lit(0))
    can = differ * (rule.over + rule.under) <= (F.col("n") + F.col("n_a")) * (rule.over - rule.under)
    once = (F.col("root") == F.col("main")) | (F.col("class") < F.col("class_a"))
    pairs = outside.join(own, "key").where((F.col("root") != F.col("root_a")) & once & rule.sized(F.col("n"), F.col("n_a")) & can)
    return pairs.select(F.col("class_a").alias("a"), "class")


def joined(ready: Prepared, hubs: int = 2) -> DataFrame:
    """The component of every class that links with another: node, root."""
    rule, groups = ready.rule, ready.groups
    hub = groups.where(F.col("rank") < hubs).select("key", F.col("rank").alias("rank_a"), F.col("class").alias("a"), F.col("n").alias("n_a"))
    pairs = hub.join(groups, "key").where((F.col("rank") > F.col("rank_a")) & rule.sized(F.col("n"), F.col("n_a")))
    pairs = written(pairs.select("a", F.col("class").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return groups.select(F.col("class").alias("node"), F.col("class").alias("root")).limit(0)
    roots = written(components(_linked(pairs, ready.docs, ready.classes, rule)), "roots")

    own = groups.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    split = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    own = written(own.join(split, "key", "left_semi"), "unjoined")
    pairs = written(_apart(own, ready.classes, rule).select("a", F.col("class").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return roots
    more = _linked(pairs, ready.docs, ready.classes, rule)
    return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "roots")


def links(docs: DataFrame, rule: Rule | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All linked pairs of classes (a, b), and the members of each class (id, n, class)."""
    ready = prepare(docs, rule or Rule(), doc_id, text)
    other = ready.groups.select("key", F.col("rank").alias("rank_a"), F.col("class").alias("a"), F.col("n").alias("n_a"))
    pairs = other.join(ready.groups, "key").where((F.col("rank") > F.col("rank_a")) & ready.rule.sized(F.col("n"), F.col("n_a")))
    pairs = written(pairs.select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct(), "pairs")
    return _linked(pairs, ready.docs, ready.classes, ready.rule), ready.members.join(ready.classes.select("set", "class"), "set", "left").select("id", "n", "class")


def grouped(docs: DataFrame, rule: Rule | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, print (hash of id and text), n (set size), component.

    ``component`` is the smallest id that can be reached by links, the document's own included.
    """
    ready = prepare(docs, rule or Rule(), doc_id, text)
    roots = joined(ready).withColumnRenamed("node", "class")
    own = ready.classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = own.groupBy("root").agg(F.min("first.id").alias("component"))
    own = written(own.join(least, "root").select("set", "component"), "components")
    return ready.members.join(own, "set", "left").select("id", "print", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def without_near_copies(docs: DataFrame, rule: Rule | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (then text).

    Documents without a shingle all stay. Of rows that repeat an id and text one stays.
    """
    ready = prepare(docs, rule or Rule(), doc_id, text)
    roots = joined(ready).withColumnRenamed("node", "class")
    own = ready.classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    first = own.groupBy("root").agg(F.min(F.struct("first.none", "first.id", "first.print")).alias("kept"))
    first = own.select("set", "root").join(first, "root").select("set", F.col("kept.id").alias("kept_id"), F.col("kept.print").alias("kept_print"))
    members = ready.members.where("n > 0").select("id", "print", "set")
    other = ~F.col("id").eqNullSafe(F.col("kept_id")) | (F.col("print") != F.col("kept_print"))
    removed = written(members.join(first, "set").where(other).select("id", "print").distinct(), "removed")
    repeated = written(members.groupBy("id", "print").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")

    key, number = free_name(docs, "print"), free_name(docs, "number")
    marked = docs.withColumn(key, F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))))

    def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(sent_if_small(ids), (rows[key] == ids["print"]) & rows[doc_id].cast("long").eqNullSafe(ids["id"]), how)

    kept = among(marked, removed, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    same = Window.partitionBy(key, doc_id).orderBy(key)
    once = among(kept, repeated, "left_semi").withColumn(number, F.row_number().over(same)).where(F.col(number) == 1)
    return among(kept, repeated, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
