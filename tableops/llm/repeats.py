"""Removing long strings that repeat anywhere in the corpus, by prefix-free parsing.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed, whichever copy it is.

**Phrases.** A rolling hash of 8 bytes triggers where it is smaller than the ``AROUND`` hashes on either side. The
bytes that decide on it, the trigger string of ``TRIGGER`` bytes, depend on nothing else, so equal texts are
cut alike; phrases run from one trigger string to the next and share it, so no phrase suffix longer than
a trigger string is the prefix of another. A suffix of the text is thus the end of a phrase and the parse
after it, and two suffixes of equal beginnings have the same trigger at the same distance.

**Parse.** The starts before a trigger (up to ``NEAR`` bytes, and those further away as a class of their own) all hold
the same bytes after it, the *core*, and lie within the *stretch* from the first of them to the end of the
last one's string. Suffixes of the parse are ordered by fingerprints of core and stretch: starts whose core
stands nowhere else are settled, and so are those whose core always stands in one and the same stretch.

**Dictionary.** What is left, cores in different stretches, are ends of repeats. The distinct stretches are the dictionary; their
suffixes are sorted as strings, cut at ``LENGTH`` bytes, so that equal ones are neighbours in corpus order.
Dictionary places get back to the text by their core and stretch. A core with more than ``MOST`` different
stretches is not sorted in one task: its suffixes become rows, which Spark groups.

Strings without any trigger string in them (runs and short periods) are classes by themselves; those that
repeat within a text are settled on the spot.

Texts never travel with their phrases. A text is known by its id and a 64-bit hash; texts are joined twice, with
the places of new stretches and with what is to be removed. These tables are broadcast where small.

Defined results: a missing or empty text has nothing to remove; so has one shorter than ``LENGTH``. Rows that repeat a
text, with the same id or another, are copies of each other. A missing id is passed through. An empty
table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.frames import sent_if_small
from tableops.llm.texts import flat, mixed, slices
from tableops.plans.scratch import written

#: Bytes of a string that must not repeat.
LENGTH = 200
#: Hashes on either side that a trigger's is smaller than; the bytes that decide; starts before it that are one class.
AROUND = 24
TRIGGER = 2 * AROUND + 8
NEAR = 96
#: Different stretches of a core that are sorted together at most.
MOST = 2_000
#: Starts that are looked at together, and bytes beside them that they depend on.
BLOCK, BESIDE = 1 << 18, 512

_SEED = np.random.Generator(np.random.PCG64(20250811))
_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_SEED.integers(2**40, 2**62)) * 2 + 1


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 2**64))
        done += take
    return out


class Fingerprints:
    """Fingerprints of any spans of a run of bytes, from prefix sums."""

    def __init__(self, up: np.ndarray, down: np.ndarray, data: np.ndarray) -> None:
        self.sums, self.down = np.zeros(len(data) + 1, np.uint64), down
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def triggers(data: np.ndarray) -> np.ndarray:
    """Where trigger strings start."""
    n = len(data) - 7
    if n < 2 * AROUND + 1:
        return np.zeros(0, np.int64)
    hashes = mixed(np.ndarray(n, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64))
    least, span = hashes, 1
    while span < AROUND:  # the least of AROUND hashes from each place on
        step = min(span, AROUND - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    middle, count = hashes[AROUND : n - AROUND], n - 2 * AROUND
    return np.flatnonzero((middle < least[:count]) & (middle < least[AROUND + 1 : AROUND + 1 + count]))


def classes(data: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """The classes of starts of a text: core, stretch (fingerprints), trigger, furthest and nearest start before it.

    Runs of starts that are known to repeat come as rows of their own: any two numbers, the first start, how
    far behind it the last one is (as a negative distance), -1.
    """
    n, reach = len(data), LENGTH - TRIGGER  # a string holds the trigger string up to so many bytes after its start
    for base in range(0, n - TRIGGER + 1 if n >= LENGTH else 0, BLOCK):
        low = max(0, base - BESIDE)
        own = data[low : base + BLOCK + BESIDE]
        size, print_of = len(own), Fingerprints(*tables, own)
        at = triggers(own)
        gap = np.minimum(np.diff(at, prepend=-1 if low == 0 else -BESIDE), reach + 1)
        here = (at + low >= base) & (at + low < base + BLOCK)
        t, gap = at[here], gap[here]
        for code, nearest, furthest in ((1, 0, NEAR), (2, NEAR + 1, reach)):
            far, near = np.minimum(gap - 1, furthest), np.maximum(nearest, t + LENGTH - size)
            some = near <= far
            s, far, near = t[some], far[some], near[some]
            core = mixed(print_of(s, s + LENGTH - furthest) + np.uint64(code))
            stretch = mixed(print_of(s - far, s - near + LENGTH) + (far << 20 | near << 4 | code).astype(np.uint64))
            yield core, stretch, s + low, far, near
        starts = np.arange(base - low, min(base + BLOCK - low, size - LENGTH + 1))
        after = np.append(at, size + LENGTH)[np.searchsorted(at, starts)]
        starts = starts[after - starts > reach]
        if len(starts):
            whole = mixed(print_of(starts, starts + LENGTH) + np.uint64(3))
            _, first, back, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            again = count[back] > 1
            once = np.zeros(len(starts), bool)
            once[first] = True
            rows = np.concatenate([np.flatnonzero(once), np.flatnonzero(once & again)])  # repeated ones twice, so that all see a second
            zero = np.zeros(len(rows), np.int64)
            yield whole[rows], whole[rows], starts[rows] + low, zero, zero
            runs = starts[again]
            if len(runs):
                new = np.append(True, np.diff(runs) > 1)
                length = np.diff(np.append(np.flatnonzero(new), len(runs)))
                label = mixed(whole[again][new] + np.uint64(4))
                yield label, label, runs[new] + low, 1 - length, np.full(len(length), -1)


ROWS = "core long, stretch long, id long, tie long, at long, far int, near int"


def known(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The texts with the two numbers they are known by; a missing id is replaced by a hash of the text."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    number = F.col("doc_id").cast("long") if docs.schema[doc_id].dataType.simpleString() in ("bigint", "int") else F.xxhash64("doc_id")
    return texts.select("doc_id", "text", F.coalesce(number, F.xxhash64("text")).alias("id"), F.xxhash64("text", F.lit(1)).alias("tie"))


def parsed(texts: DataFrame) -> DataFrame:
    """The classes of starts of all texts (see ``classes``) with the numbers of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _powers(_BASE, BLOCK + 2 * BESIDE + 1), _powers(pow(_BASE, -1, 2**64), BLOCK + 2 * BESIDE + 1)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, bounds = flat(part.column("text"))
                ids, ties = part.column("id").to_numpy(), part.column("tie").to_numpy()
                for row in np.flatnonzero(np.diff(bounds) >= LENGTH):
                    for core, stretch, at, far, near in classes(data[bounds[row] : bounds[row + 1]], tables):
                        many = len(core)
                        columns = [core.view(np.int64), stretch.view(np.int64), np.full(many, ids[row]), np.full(many, ties[row]), at, far.astype(np.int32), near.astype(np.int32)]
                        if many:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in ROWS.split(", ")])

    return texts.select("text", "id", "tie").mapInArrow(run, ROWS)


def stretches(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of each wanted stretch (core, stretch, n, id, tie, at, far, near), one row each."""
    lists = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("core", "stretch", "n", "at", "far", "near", "large")).alias("places"))
    lists = sent_if_small(written(lists, "places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column("text"), batch.column("places").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for i in range(0, len(places), 4096):
                    some = places[i : i + 4096]
                    made = {k: [p[k] for p in some] for k in ("core", "stretch", "n", "far", "near", "large")}
                    made["bytes"] = [data[p["at"] - p["far"] : p["at"] - p["near"] + LENGTH] for p in some]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made.values(), kinds, strict=True)], names=list(made))

    joined = texts.select("id", "tie", "text").join(lists, ["id", "tie"])
    made = joined.select("text", "places").mapInArrow(cut, "core long, stretch long, n long, far int, near int, large boolean, bytes binary")
    return made.dropDuplicates(["core", "stretch"])  # a row may stand in the table many times


def suffixes(rows: list[tuple[bytes, int, int, int]]) -> list[list[tuple[int, int]]]:
    """For each stretch (bytes, n, far, near) the runs of distances whose strings repeat: a suffix array cut at ``LENGTH`` bytes.

    The suffixes of all stretches are sorted as strings; one repeats if its stretch stands in the text more than once
    or a neighbour is the same.
    """
    data = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    many = np.array([far - near + 1 for _, _, far, near in rows])
    sizes = np.array([len(r[0]) for r in rows])
    of = np.repeat(np.arange(len(rows)), many)
    step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(np.cumsum(sizes) - sizes, many) + step
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start].reshape(-1).view(f"S{LENGTH}")
    order = np.argsort(strings, kind="stable")
    same = strings[order[1:]] == strings[order[:-1]]
    hit = np.zeros(len(of), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    hit |= np.array([r[1] for r in rows])[of] > 1
    distance = np.array([r[2] for r in rows])[of] - step
    found: list[list[tuple[int, int]]] = [[] for _ in rows]
    places = np.flatnonzero(hit)
    if len(places):
        new = np.append(True, (np.diff(places) > 1) | (of[places[1:]] != of[places[:-1]]))
        first, last = places[new], places[np.append(new[1:], True)]
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            found[of[a]].append((int(distance[a]), int(distance[b])))
    return found


HITS = "core long, stretch long, runs array<struct<far: int, near: int>>"
_RUNS = pa.list_(pa.struct([("far", pa.int32()), ("near", pa.int32())]))


def _runs(core: list, stretch: list, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    runs = pa.array([[{"far": a, "near": b} for a, b in x] for x in found], _RUNS)
    return pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(stretch, pa.int64()), runs], names=["core", "stretch", "runs"])


def sorted_dictionary(dictionary: DataFrame) -> DataFrame:
    """The stretches with strings that repeat, and which: core, stretch, runs of distances (furthest, nearest)."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []

        def done(rows: list[dict]) -> pa.RecordBatch:
            found = suffixes([(r["bytes"], r["n"], r["far"], r["near"]) for r in rows])
            return _runs([r["core"] for r in rows], [r["stretch"] for r in rows], found)

        for batch in batches:
            for row in batch.to_pylist():
                if len(kept) >= 1024 and row["core"] != kept[-1]["core"]:
                    yield done(kept)
                    kept = []
                kept.append(row)
        if kept:
            yield done(kept)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                many = r["far"] - r["near"] + 1
                strings = [r["bytes"][k : k + LENGTH] for k in range(many)]
                columns = [pa.array([r["core"]] * many), pa.array([r["stretch"]] * many), pa.array([r["n"]] * many), pa.array([r["far"] - k for k in range(many)], pa.int32()), pa.array(strings, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["core", "stretch", "n", "distance", "string"])

    small = dictionary.where(~F.col("large")).drop("large").repartition("core").sortWithinPartitions("core")
    rows = dictionary.where("large").mapInArrow(apart, "core long, stretch long, n long, distance int, string binary")
    twice = rows.groupBy("string").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("string")
    hits = rows.join(twice, "string").select("core", "stretch", F.array(F.struct(F.col("distance").alias("far"), F.col("distance").alias("near"))).alias("runs"))
    return small.mapInArrow(sort, HITS).where(F.size("runs") > 0).unionByName(hits)


def starts(texts: DataFrame) -> DataFrame:
    """Runs of starts whose strings repeat, for each text: id, tie, runs (first, last), merged and in order."""
    rows = parsed(texts)
    cores = rows.where(F.col("near") >= 0).groupBy("core").agg(F.count("*").alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most"))
    cores = written(cores.where(F.col("n") > 1).select("core", (F.col("least") != F.col("most")).alias("differ")), "cores")
    # The second reading of the texts keeps what the first one found twice; runs that are settled come along.
    found = rows.join(cores, "core", "left").where(F.col("differ").isNotNull() | (F.col("near") < 0))
    found = written(found.select(*[c.split()[0] for c in ROWS.split(", ")], F.coalesce("differ", F.lit(False)).alias("differ")), "repeated")
    differ = found.where("differ")
    new = differ.groupBy("core", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("id", "tie", "at", "far", "near")).alias("place"))
    new = written(new.select("core", "stretch", "n", "place.*"), "stretches")
    large = written(new.groupBy("core").agg(F.count("*").alias("many")).where(F.col("many") > MOST).select("core", F.lit(True).alias("large")), "large")
    new = new.join(sent_if_small(large), "core", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    hits = written(sorted_dictionary(written(stretches(texts, new), "dictionary")), "hits")
    ends = differ.join(sent_if_small(hits), ["core", "stretch"]).select("id", "tie", "at", F.inline("runs"))
    whole = found.where(~F.col("differ")).select("id", "tie", "at", "far", F.greatest("near", F.lit(0)).alias("near"))
    settled = F.when(F.col("far") < 0, F.struct(F.col("at").alias("first"), (F.col("at") - F.col("far")).alias("last")))
    run = F.coalesce(settled, F.struct((F.col("at") - F.col("far")).alias("first"), (F.col("at") - F.col("near")).alias("last")))
    spans = whole.unionByName(ends).select("id", "tie", run.alias("run"))
    lists = spans.groupBy("id", "tie").agg(F.collect_set("run").alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value in batch.column("runs"):
                own = value.values
                first, last = own.field("first").to_numpy(), own.field("last").to_numpy()
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                new = np.append(True, first[1:] > last[:-1] + 1)
                made.append([{"first": a, "last": b} for a, b in zip(first[new].tolist(), last[np.append(new[1:], True)].tolist(), strict=True)])
            runs = pa.array(made, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), runs], names=["id", "tie", "runs"])

    return lists.mapInArrow(merge, "id long, tie long, runs array<struct<first: long, last: long>>")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_bytes`` also ``spans`` and the bytes ``kept``.

    What is kept are bytes, as a repeat can begin or end within a character.
    """
    texts = known(docs, doc_id, text)
    runs = sent_if_small(written(starts(texts), "starts"))
    kind = docs.schema[doc_id].dataType.simpleString()
    extra = ", spans array<struct<start: long, end: long>>, kept binary" * with_bytes

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, digests, spans, rests = [], [], [], [], [], []
            for value, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                data, at, kept, out = memoryview(value.as_buffer()), 0, [], []
                for run in runs or []:
                    start, end = run["first"], run["last"] + LENGTH
                    if out and start <= out[-1]["end"]:
                        out[-1]["end"] = end
                    else:
                        out.append({"start": start, "end": end})
                digest = sha256()
                for span in out:
                    kept.append((at, span["start"]))
                    at = span["end"]
                kept.append((at, len(data)))
                for a, b in kept:
                    digest.update(data[a:b])
                sizes.append(len(data))
                removed.append(sum(s["end"] - s["start"] for s in out))
                counts.append(len(out))
                digests.append(digest.hexdigest())
                if with_bytes:
                    spans.append(out)
                    rests.append(b"".join(data[a:b] for a, b in kept))
            made = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, counts)], pa.array(digests, pa.string())]
            if with_bytes:
                made += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(rests, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans", "kept"] * with_bytes])

    joined = texts.join(runs, ["id", "tie"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
