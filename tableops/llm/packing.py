"""Best-fit packing of documents into sequences of a fixed length, by matching large pieces first.

A document's ids end with ``end_id``. Documents longer than a sequence are cut into full
sequences and a rest; nothing else is cut. The pieces are packed by their lengths alone, of which
there are at most ``capacity`` different ones, so the plan is made from a histogram of fixed size
and is the same for one sequence or 10^12:

1. Pieces of more than a third of the capacity are *large*: at most two go into one sequence. From the
   longest down, each is paired with the longest large piece that still fits.
2. The small pieces follow, longest first, each into the smallest gap that holds it (best fit);
   what fits nowhere opens new sequences.

The plan works on counts: a step places as many equal pieces into as many equal gaps as there
are, and is written down as one run (length, first rank, pieces, first sequence, offset). A piece
finds its run by its rank among the pieces of its length. The rank is its place within its task's
output, counted as it is written, plus the sum of the counts of the tasks before it; so no length,
however common, is gathered or sorted in one place.

Defined results: a missing or empty text is the end id alone, a piece of length 1. Rows that
repeat a document, its id or both are pieces of their own. An empty table gives no sequences.
Ties between pieces of one length are broken by the order of the written rows. Columns that are not
asked for are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.frames import forget_tokens, small_batches
from tableops.llm.texts import slices
from tableops.llm.tokens import REMEMBERED, crc32, encoder, lists
from tableops.plans.scratch import written

CAPACITY = 4096


def cut(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of all documents: id, piece, start, length, ids_crc32, task, rank within task and length (and ids)."""
    fields = "id long, piece int, start long, length int, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode, ranks = TaskContext.get().partitionId(), encoder(tokenizer_json, remembered), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, own = [], []
                for key, ids in zip(part.column("id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        found = ids[start : start + capacity]
                        rows.append((key, piece, start, len(found), crc32(found), task, int(ranks[len(found)])))
                        ranks[len(found)] += 1
                        if with_ids:
                            own.append(found)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns + [lists(own)] * with_ids, names=[f.split()[0] for f in fields.split(", ")])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInArrow(run, fields)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place ``counts[length]`` pieces of each length."""
    runs, used, sequences = [], dict.fromkeys(counts, 0), 0
    left = {k: n for k, n in counts.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space: blocks of (first sequence, how many)
    sizes: list[int] = []  # the gaps there are, in order

    def free(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            heapq.heappush(gaps[gap], (first, n))

    def place(length: int, first: int, n: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            fits = next((k for k in reversed(large[: bisect_left(large, capacity - length + 1)]) if left[k] and k <= length), None)
            if fits is None:
                n = left[length]
                place(length, sequences, n, 0)
                free(capacity - length, sequences, n)
            else:
                n = min(left[length], left[fits]) if fits != length else left[length] // 2
                if not n:  # a last one, without its like: the next shorter that is left
                    shorter = next((k for k in reversed(large[: bisect_left(large, length)]) if left[k] and k + length <= capacity), None)
                    n = 1
                    place(length, sequences, n, 0)
                    if shorter:
                        place(shorter, sequences, n, length)
                    free(capacity - length - (shorter or 0), sequences, n)
                    sequences += n
                    continue
                place(length, sequences, n, 0)
                place(fits, sequences, n, length)
                free(capacity - length - fits, sequences, n)
            sequences += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # new sequences, as full of this length as they get
                each = capacity // length
                n = left[length] // each
                if n:
                    first, rest = sequences, capacity - each * length
                    for k in range(each):
                        place(length, first, n, k * length)
                    free(rest, first, n)
                    sequences += n
                else:
                    free(capacity, sequences, 1)
                    sequences += 1
                continue
            gap = sizes[at]
            first, n = heapq.heappop(gaps[gap])
            take = min(n, left[length])
            place(length, first, take, capacity - gap)
            if take < n:
                heapq.heappush(gaps[gap], (first + take, n - take))
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            free(gap - length, first, take)
    return runs


def packed(pieces: DataFrame, capacity: int = CAPACITY, forget: bool = False) -> DataFrame:
    """Written pieces with their ``sequence_id`` and ``offset``; the work columns dropped.

    Each run of the plan ends a length or a block of gaps, so there are a few per length; they are
    sent to the tasks as arrays. Full pieces are placed like all others.
    """
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = written(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    sent = pieces.sparkSession.sparkContext.broadcast(runs)
    placed = pieces.join(by_task.drop("n"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "task")
    names = [c for c in placed.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget:
            forget_tokens()
        runs = sent.value
        firsts = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(firsts, batch.column("length").to_numpy().astype(np.int64) << 48 | rank, "right") - 1
            own = runs[at]
            extra = [pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + extra, names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([placed.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    """Where each piece of each document is placed; with ``with_ids`` also its token ids.

    A worker remembers ``remembered`` words of the tokenizer at most, and with ``forget`` none once they are encoded.
    """
    return packed(written(cut(docs, tokenizer_json, end_id, capacity, doc_id, text, with_ids, remembered), "pieces"), capacity, forget)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids, and the pieces' lengths in order."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts.ids", lambda x: F.size(x)).alias("lengths"))
