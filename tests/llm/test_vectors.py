"""The two vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from accordance.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def _found(rows):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [(i, round(s, 9)) for _, i, s in sorted(v)] for q, v in got.items()}


def _brute(x, ids, step, k):
    """By float64 inner products; ties to smaller ids."""
    want = {}
    for q in range(len(x)):
        if ids[q] % step == 0 and ids[q] not in want:
            score = (x * x[q]).sum(axis=1)
            want[ids[q]] = [(i, s) for s, i in sorted((-s, i) for s, i in zip(score, ids) if i != ids[q])[:k]]
    return {q: [(i, round(float(-s), 9)) for i, s in v] for q, v in want.items()}


def test_repeated_rows_are_candidates_each(spark):
    x = np.random.default_rng(1).normal(size=(40, 8)).astype("float32").astype(float)
    x[7] = 2 * x[0]
    ids = [*range(40), *[7] * 6, *[20] * 2]  # row 7 seven times, and a query's own row three times
    x = np.concatenate([x, x[[7] * 6], x[[20] * 2]])
    x[5] = x[6] = x[7]  # equal vectors of other ids
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    want = _brute(x, ids, 20, 8)
    assert _found(ann.nearest(table, F.col("vec_id") % 20 == 0, k=8, target=1.0).collect()) == want
    whole = _brute(np.floor(256 * x), ids, 20, 8)
    got = _found(topk.exact_top_k(table, F.col("vec_id") % 20 == 0, k=8).collect())
    assert got == whole and any([i for i, _ in v].count(7) == 6 for v in got.values())


def test_small_tables_give_all_candidates(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 20):
        x = rng.normal(size=(n, 64)).astype("float32").astype(float)
        table = spark.createDataFrame([(20 * k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
        got = _found(ann.nearest(table, F.col("vec_id") % 20 == 0, k=20).collect())
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in _brute(x, [20 * k for k in range(n)], 20, 20).items() if v}


def test_hot_vectors_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 16))
    x[60:] = x[60]  # most rows have one vector
    rows = [(k, v.tolist(), "a", 1.5) for k, v in enumerate(x)] + [(None, x[1].tolist(), "", 0.0), (1000, None, "", 0.0), (1020, [], "", 0.0), (1040, [0.0] * 16, "", 0.0), (1060, [float("inf")] * 16, "", 0.0), (1080, [None] * 16, "", 0.0), (1100, x[0, :7].tolist(), "", 0.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string, vec double")  # columns with clashing names
    got = _found(ann.nearest(table, F.col("vec_id") % 20 == 0, k=20).collect())
    want = _brute(x, list(range(200)), 20, 20)
    assert got.keys() == want.keys()
    hot = [q for q in want if q >= 60]
    assert all(got[q] == want[q] for q in hot) and [i for i, _ in got[80]][:3] == [60, 61, 62]
    ints = table.where("vec_id < 200 or vec_id is null or vec_id = 1020 or vec_id = 1080")
    assert _found(topk.exact_top_k(ints, F.col("vec_id") % 20 == 0, k=20).collect()) == _brute(np.floor(256 * x), list(range(200)), 20, 20)
    for search in (ann.nearest, topk.exact_top_k):
        assert search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
        assert search(table, F.lit(None).cast("boolean")).count() == 0


def test_recall_on_random_and_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    random = rng.normal(size=(1500, 64))
    centers = rng.normal(size=(100, 64))
    clustered = np.repeat(centers, 30, axis=0) + 0.4 * rng.normal(size=(3000, 64))
    for x, most in ((random, 1.0), (clustered, 0.1)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        got, want = _found(ann.nearest(table, F.col("vec_id") % 20 == 0, k=20).collect()), _brute(x, list(range(len(x))), 20, 20)
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
        assert all(abs(s - x[i] @ x[q]) < 1e-8 for q, v in got.items() for i, s in v)
        hasher = ann.CrossPolytope(64, 2, len(x), 7, None)
        rows = table.select("vec_id", F.lit(True).alias("is_query"), F.col("embedding").alias("vec"), F.lit(64).alias("dim"), F.xxhash64("embedding").alias("v1"), F.lit(0).alias("v2"))
        probes = ann._probes(ann._distinct(rows, {64: hasher}, 20), {64: hasher}, 20, 100, 0.96)
        assert 2 * probes[64] / hasher.buckets_a_table <= most


def test_two_hashes(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(100, 32)), 40, axis=0) + 0.3 * rng.normal(size=(4000, 32))
    assert ann.CrossPolytope(32, 2, 4000, 7, 5.0).buckets_a_table > 128
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got, want = _found(ann.nearest(table, F.col("vec_id") % 40 == 0, k=20).collect()), _brute(x, list(range(4000)), 40, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 1024 * 8)
    monkeypatch.setattr(ann, "BLOCK_CELLS", 200 * 8)
    x = np.random.default_rng(6).normal(size=(5000, 8)).astype("float32").astype(float)
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    assert _found(topk.exact_top_k(table, F.col("vec_id") % 3 == 0, k=5).collect()) == _brute(np.floor(256 * x), list(range(5000)), 3, 5)
    got, want = _found(ann.nearest(table, F.col("vec_id") % 100 == 0, k=20).collect()), _brute(x, list(range(5000)), 100, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_components_beyond_doubles(spark):
    table = spark.createDataFrame([(0, [3e15, 1.0], 0), (1, [3e15, 2.0], 0), (2, [-1e30, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    got = _found(topk.exact_top_k(table, F.col("vec_id") == 0, k=5).collect())
    assert [i for i, _ in got[0]] == [1, 2] and got[0][0][1] == 2**63 - 1
