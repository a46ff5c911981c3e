"""Approximate nearest neighbours by cross-polytope hashing.

*Hash.* A unit vector, filled up with zeros to a power of two, is turned by three rounds of random signs
and a fast Hadamard transform; its hash is the signed axis it comes nearest to. A table joins as
many hashes as leave about ``BUCKET`` vectors to a bucket, the last one over fewer axes if need be.

*Probes.* A query looks into the buckets of the axes that its turned vector is nearest to, the
likeliest of each of ``TABLES`` tables. How many is measured on the table itself: the true neighbours of
``SAMPLE`` queries are found by brute force, and so many buckets are probed (``PROBES`` at least) that
``AIM`` of them stand in one. So recall holds as buckets grow in number, and where
lengths differ, which the buckets do not see.

*Reranking.* In each bucket the exact distances (double precision, original vectors) of its queries to
all its vectors are taken and the nearest ``k`` kept; the nearest ``k`` over all buckets are the result.
Vectors stream past the queries of their bucket. A bucket with many vectors is dealt to
several tasks, each with its queries, and equal vectors beyond the k + 1 smallest ids are left out
before (no answer can hold them), so neither a hot vector nor a hot bucket meets in one task.

Recall at 10 against brute force: see the README.

Defined results: vectors that are missing, all zero, or hold a missing or non-finite component take
no part. Vectors of different lengths are never compared. Rows that repeat an id and a vector
count once; a row never is its own answer, nor any row of the same id. Ties go to the smaller id. A query that
finds fewer than k candidates returns those. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.plans.scratch import written

TABLES = 12
#: Buckets of a table that a query looks into at least.
PROBES = 6
#: Queries of each length that the number of probes is measured on, and the share of their neighbours to be found.
SAMPLE = 64
AIM = 0.95
#: Vectors of a bucket that the number of hashes aims at.
BUCKET = 400


def _signs(dims: int, table: int, place: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([17, dims, table, place])).choice((-1.0, 1.0), (3, dims))


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and a normalised fast Hadamard transform, for each row."""
    for sign in signs:
        x, step = x * sign, 1
        while step < x.shape[1]:
            x = x.reshape(len(x), -1, 2, step)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), -1)
            step *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def widths(n: int, dims: int, bucket: int = BUCKET) -> list[int]:
    """How many axes each hash of a table chooses from, for ``n`` vectors."""
    full, out, left = 1 << (dims - 1).bit_length(), [], max(1.0, n / bucket)
    while left > 2 or not out:
        axes = min(full, 1 << max(0, int(np.ceil(np.log2(left / 2)))))
        out.append(axes)
        left /= 2 * axes
    return out


def codes(x: np.ndarray, axes: list[int], table: int, probes: int) -> np.ndarray:
    """The likeliest ``probes`` buckets of each row in a table, nearest first."""
    step = max(1, (1 << 20) // (probes * 2 * max(axes)))
    return np.concatenate([_codes(x[i : i + step], axes, table, probes) for i in range(0, len(x), step)])


def _codes(x: np.ndarray, axes: list[int], table: int, probes: int) -> np.ndarray:
    full = 1 << (x.shape[1] - 1).bit_length()
    unit = np.zeros((len(x), full))
    unit[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    found, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for place, width in enumerate(axes):
        near = turned(unit, _signs(full, table, place))[:, :width]
        near = np.concatenate((near, -near), axis=1)
        most = min(probes, 2 * width)
        best = np.argsort(-near, axis=1, kind="stable")[:, :most]
        miss = near.max(axis=1, keepdims=True) - np.take_along_axis(near, best, axis=1)
        cost = (cost[:, :, None] + miss[:, None, :] ** 2).reshape(len(x), -1)
        found = (found[:, :, None] * (2 * width) + best[:, None, :]).reshape(len(x), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        found, cost = np.take_along_axis(found, order, axis=1), np.take_along_axis(cost, order, axis=1)
    return found


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """The vectors that take part: id, v, dims."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & whole).withColumn("dims", F.size("v"))


def _needed(kept: DataFrame, queries: DataFrame, sizes: dict[int, list[int]], k: int, tables: int, least: int) -> dict[int, int]:
    """For each length of vectors the probes that find ``AIM`` of the true neighbours of a sample of its queries."""
    place = F.row_number().over(Window.partitionBy("dims").orderBy(F.xxhash64("id"), "id", "v"))
    sample = queries.withColumn("place", place).where(F.col("place") <= SAMPLE).select("dims", "id", "v").collect()
    by_dims = {d: [(i, r["id"], np.array(r["v"])) for i, r in enumerate(sample) if r["dims"] == d] for d in sizes}
    sent = kept.sparkSession.sparkContext.broadcast(by_dims)

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                ids, x = part.column("id").to_numpy(), part.column("v").flatten().to_numpy().reshape(-1, d)
                for i, own, query in sent.value[int(d)]:
                    other = np.flatnonzero(ids != own)
                    score = np.sqrt(((x[other] - query) ** 2).sum(axis=1))
                    first = np.lexsort((ids[other], score))[:k]
                    found = score[first], ids[other[first]], x[other[first]]
                    found = tuple(np.concatenate(c) for c in zip(best[i], found, strict=True)) if i in best else found
                    first = np.lexsort((found[1], found[0]))[:k]
                    best[i] = tuple(c[first] for c in found)
        for i, (score, ids, x) in best.items():
            columns = [pa.array(np.full(len(ids), i)), pa.array(ids), pa.array(score), pa.array(list(x), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score", "v"])

    near = kept.select("dims", "id", "v").mapInArrow(closest, "query long, id long, score double, v array<double>")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    near = near.withColumn("place", place).where(F.col("place") <= k).collect()
    found: dict[int, list] = {}
    for r in near:
        found.setdefault(r["query"], []).append(r["v"])
    out = {}
    for d, axes in sizes.items():
        most, all_buckets = max(64, least), int(np.prod([2 * a for a in axes]))
        of = np.repeat([j for j, (i, _, _) in enumerate(by_dims[d])], [len(found.get(i, ())) for i, _, _ in by_dims[d]]).astype(int)
        out[d] = least
        if len(of):
            x, own = np.array([v for i, _, _ in by_dims[d] for v in found.get(i, ())]), np.array([v for _, _, v in by_dims[d]])
            while True:
                rank = np.full(len(of), np.inf)
                for table in range(tables):
                    same = codes(own, axes, table, most)[of] == codes(x, axes, table, 1)
                    rank = np.minimum(rank, np.where(same.any(axis=1), same.argmax(axis=1) + 1, np.inf))
                need = np.sort(rank)[int(np.ceil(AIM * len(rank))) - 1]
                if need < np.inf or most >= all_buckets:
                    break
                most *= 4
            out[d] = int(min(max(least, need), max(least, all_buckets)))
    return out


def _hashed(rows: DataFrame, sizes: dict[int, list[int]], tables: int, probes: dict[int, int]) -> DataFrame:
    """Each row's buckets: dims, tab, code, id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = part.column("v").flatten().to_numpy().reshape(-1, d)
                for table in range(tables):
                    found = codes(x, sizes[int(d)], table, probes[int(d)])
                    for probe in found.T:
                        columns = [part.column("dims"), pa.array(np.full(len(x), table, np.int32)), pa.array(probe), part.column("id"), part.column("v")]
                        yield pa.RecordBatch.from_arrays(columns, names=["dims", "tab", "code", "id", "v"])

    return rows.mapInArrow(run, "dims int, tab int, code long, id long, v array<double>")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, probes: int = PROBES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found for each row that ``is_query`` marks: query_id, rank (from 1), vec_id, score.

    ``is_query`` is an expression on the column ``id``; ``probes`` is the least number of them.
    """
    rows = usable(vectors, vec_id, vector)
    order = Window.partitionBy("v", "dims").orderBy("id")
    kept = rows.withColumn("copy", F.dense_rank().over(order)).where(F.col("copy") <= k + 1).drop("copy")
    kept = written(kept.distinct(), "vectors")
    sizes = {r["dims"]: widths(r["n"], r["dims"]) for r in kept.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    index = _hashed(kept, sizes, tables, dict.fromkeys(sizes, 1))
    bucket = ["dims", "tab", "code"]
    counts = index.groupBy(*bucket).agg(F.count("*").alias("n"))
    counts = written(counts.select(*bucket, F.ceil(F.col("n") / (2 * BUCKET)).cast("int").alias("deals")), "buckets")
    dealt = index.join(counts, bucket).withColumn("deal", F.pmod(F.xxhash64("id"), "deals").cast("int")).drop("deals")
    queries = written(rows.where(is_query).distinct(), "queries")
    asked = _hashed(queries, sizes, tables, _needed(kept, queries, sizes, k, tables, probes)).join(counts, bucket)
    asked = asked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids: list[int] = []
        own: list[np.ndarray] = []
        best: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            n = [len(x[0]) for x in best]
            columns = [np.repeat(np.array(ids, np.int64), n), np.concatenate([x[1] for x in best]).astype(np.int64), np.concatenate([x[0] for x in best])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("dims", "tab", "code", "deal")]
            is_asked, key_ids = batch.column("asked").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in [*keys, is_asked]], axis=0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                key = tuple(int(x[a]) for x in keys)
                if key != now:
                    if best:
                        yield done()
                    now, ids, own, best = key, [], [], []
                x = batch.column("v").slice(a, b - a).flatten().to_numpy().reshape(b - a, key[0])
                if is_asked[a]:
                    ids += key_ids[a:b].tolist()
                    own += list(x)
                    best += [(np.zeros(0), np.zeros(0, np.int64))] * (b - a)
                    continue
                for i, query in enumerate(own):
                    other = key_ids[a:b] != ids[i]
                    score = np.concatenate((best[i][0], np.sqrt(((x[other] - query) ** 2).sum(axis=1))))
                    found = np.concatenate((best[i][1], key_ids[a:b][other]))
                    first = np.lexsort((found, score))[:k]
                    best[i] = (score[first], found[first])
        if best:
            yield done()

    both = asked.withColumn("asked", F.lit(True)).unionByName(dealt.withColumn("asked", F.lit(False)))
    both = both.repartition(*bucket, "deal").sortWithinPartitions(*bucket, "deal", F.desc("asked"))
    found = both.select(*bucket, "deal", "asked", "id", "v").mapInArrow(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
