"""Exact top-k search: tiled matrix products of queries and shards, selection in each tile, tree merging.

Vectors are turned to integers, floor(scale * x) in double precision; the score is their integer inner
product. Queries and points are dealt to tiles and shards of bounded size; each pair of a tile and a
shard is one task's product, of which only each query's best k leave the task. Products are made in
doubles where they are exact there (below 2**53), else in Python's integers.

Every row is a candidate, repeated ones too: a row stored seven times is found seven times. A query finds
no row of its own id. An id that several query rows have is answered once, for the smallest of their
vectors (compared component by component). Rows with a null id or a null, empty or non-finite vector take
no part; vectors of another length than the query's are no candidates. Other columns aren't read. Without
queries, or rows, there are no results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.llm.vectors import all_pairs, best_of_block, merged, taking_part


def _product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (q * p).sum(axis=1).astype(np.int64)


def _wide(queries: np.ndarray, points: np.ndarray) -> bool:
    most = [float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0 for x in (queries, points)]
    return most[0] * most[1] * max(1, points.shape[1]) >= 2.0**53


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of all rows but its own, ties to smaller vec_id.

    ``vectors`` has vec_id and embedding; ``is_query`` says which rows are queries. The queries meet every
    row, in blocks: that work is what exactness costs. Rows are dealt to blocks by their place, so ``vectors`` should give
    the same rows in the same order if a lost partition is computed again, as files do (write a shuffled frame first).
    """
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & taking_part(vec)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.transform(vec, lambda x: F.floor(F.lit(scale) * x)).alias("vec"), F.size(vec).alias("dim")
    )
    ends = F.max(F.greatest(F.array_max("vec").cast("double"), -F.array_min("vec").cast("double")))
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), F.max("dim").alias("d"), ends.alias("high")).first()
    vec = F.col("vec").cast("array<int>" if (sizes.high or 0) < 2**31 - 1 else "array<long>").alias("vec")
    points = rows.select(F.col("vec_id").alias("key"), "vec_id", vec, "dim", F.monotonically_increasing_id().alias("spread"))
    queries = rows.where("is_query").groupBy(F.col("vec_id").alias("query")).agg(F.min("vec").alias("vec")).select("query", F.col("query").alias("own"), vec, F.size("vec").alias("dim"))

    def block(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray):
        if _wide(q, x):
            return _by_integers(q, x, ids, own, k)
        return best_of_block(q.astype(np.float64), x.astype(np.float64), ids, own, k, _product)

    found = merged(all_pairs(points, queries, sizes.n, sizes.q or 0, sizes.d or 1, k, "long", block), k, distinct=False)
    return found.select(F.col("query").alias("query_id"), F.posexplode("found").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _by_integers(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For components so large that doubles would round; sums beyond 64 bits become the nearest 64-bit number."""
    low, high = -(2**63) + 1, 2**63 - 1
    row, found, scores = [], [], []
    points = [list(map(int, v)) for v in x]
    for r, v in enumerate(q):
        v = list(map(int, v))
        each = sorted((-min(high, max(low, sum(a * b for a, b in zip(v, p)))), i, at) for at, (p, i) in enumerate(zip(points, ids.tolist())) if i != own[r])[:k]
        row += [r] * len(each)
        found += [at for _, _, at in each]
        scores += [-s for s, _, _ in each]
    return np.array(row, np.int64), np.array(found, np.int64), np.array(scores, np.int64)
