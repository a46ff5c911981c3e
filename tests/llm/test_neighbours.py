import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tableops.llm import neighbours


def brute(rows, query, k):
    """(distance, id) of the nearest to ``query``, an (id, vector), that have its length."""
    own = np.array(query[1], float)
    found = {(float(np.sqrt(((np.array(v, float) - own) ** 2).sum())), i) for i, v in rows if i != query[0] and len(v) == len(own)}
    return sorted(found)[:k]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 24))
    x = (centres[rng.integers(0, 8, 3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[100:160] = x[0]  # copies
    x[200:260] = x[1] + 0.01 * rng.normal(size=(60, 24)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(i, v, 1.0, 7) for i, v in data], "vec_id long, embedding array<float>, score double, code int").repartition(5)
    found = {}
    for r in neighbours.nearest(frame, F.col("id") % 50 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 50):
        want, got = brute(data, data[q], 10), sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert [(s, i) for _, i, s in got] == sorted((s, i) for _, i, s in got)
        for _, i, s in got:
            assert abs(s - float(np.sqrt(((x[i].astype(float) - x[q]) ** 2).sum()))) < 1e-9
        hits += len({i for _, i in want} & {i for _, i, _ in got})
    assert hits >= 0.9 * 600
    assert [i for _, i, _ in sorted(found[0])] == list(range(100, 110))


def test_odd_vectors(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (9, [])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = neighbours.nearest(frame, F.col("id").isin(0, 2, 3, 7), k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, 1, 1), (0, 2, 8)]
    assert neighbours.nearest(frame.limit(0), F.col("id") >= 0).count() == 0


def test_probes_grow_until_recall_holds(spark):
    x = np.random.default_rng(4).normal(size=(20_000, 32))
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    # One table of 64 buckets and one probe find few: what many buckets do to twelve tables.
    found = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(frame, F.col("id") % 500 == 0, tables=1, probes=1).collect()}
    hits = 0
    for q in range(0, 20_000, 500):
        score = ((x - x[q]) ** 2).sum(axis=1)
        score[q] = np.inf
        hits += sum((q, int(i)) in found for i in np.argsort(score)[:10])
    assert hits >= 0.9 * 400


def test_no_hash_for_a_rounding_excess():
    assert neighbours.widths(51_282, 64) == [64]


def test_turning_keeps_lengths_and_tables_grow():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = neighbours.turned(x, neighbours._signs(16, 0, 0))
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(x @ x.T, y @ y.T)
    assert neighbours.widths(100, 64) == [1] and neighbours.widths(51_200, 64) == [64] and len(neighbours.widths(10**8, 64)) == 3
