"""What the two vector searches share: which rows take part, exact selection in a block, all pairs of blocks, and merging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components to a block of vectors (16 MB as 4-byte numbers).
BLOCK_CELLS = 4 << 20
NO_ID = -(2**63)
#: The lists of a block: for each query the ids, keys and scores of what it found there.
_LISTS = "query long, part long, ids array<long>, keys array<long>, scores array<{}>"


def taking_part(vec: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~odd, F.lit(False))


def apart(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a cogroup with a frame of the same origin."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column whose lists have one length."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def dot(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products row by row."""
    return (q * p).sum(axis=1)


def best_of_block(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, exact: Callable = dot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best points of the block for each query: rows of queries, places of points and scores, best first, ties to smaller ids.

    A matrix product selects; ``exact(queries, points)`` scores row by row what it can't rule out.
    ``own``: the id that a query doesn't find, NO_ID for none.
    """
    out = []
    long = np.linalg.norm(points, axis=1).max(initial=0)
    for begin in range(0, len(queries), 256):
        q = queries[begin : begin + 256]
        slack = 1e-12 * np.linalg.norm(q, axis=1) * long
        bound = np.full(len(q), -np.inf)
        for at in range(0, len(points), 1 << 14):
            rough = q @ points[at : at + (1 << 14)].T
            rough[own[begin : begin + 256, None] == ids[None, at : at + (1 << 14)]] = -np.inf
            if rough.shape[1] > k:
                bound = np.maximum(bound, np.partition(rough, -k, axis=1)[:, -k])
            row, col = np.nonzero((rough >= (bound - slack)[:, None]) & (rough > -np.inf))
            for part in range(0, len(row), 1 << 14):
                r, c = row[part : part + (1 << 14)], col[part : part + (1 << 14)] + at
                out.append(best(r + begin, ids[c], exact(q[r], points[c]), k, c))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), exact(queries[:0], points[:0])
    row, place, score = (np.concatenate(x) for x in zip(*out))
    return best(row, ids[place], score, k, place)


def best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, as row, ``what`` and score."""
    order = np.lexsort((ids, -scores, row))
    row, what, scores = row[order], what[order], scores[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = place < k
    return row[keep], what[keep], scores[keep]


def lists(query: np.ndarray, part: int, row: np.ndarray, ids: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> pa.Table:
    """A list for each query from what was found for its ``row``."""
    at = pa.array(np.searchsorted(row, np.arange(len(query) + 1)).astype(np.int32))
    each = {name: pa.ListArray.from_arrays(at, pa.array(x)) for name, x in (("ids", ids.astype(np.int64)), ("keys", keys.astype(np.int64)), ("scores", scores))}
    return pa.table({"query": pa.array(query, pa.int64()), "part": pa.array(np.full(len(query), part), pa.int64()), **each})


def nothing(kind: pa.DataType) -> pa.Table:
    """No lists."""
    return pa.table({"query": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), **{c: pa.array([], pa.list_(t)) for c, t in (("ids", pa.int64()), ("keys", pa.int64()), ("scores", kind))}})


def cogrouped(points: DataFrame, queries: DataFrame, keys: tuple[str, ...], search: Callable, kind: str) -> DataFrame:
    """The lists that ``search(key, points, queries)`` makes of the Arrow tables of each group that has both."""
    none = nothing(pa.int64() if kind == "long" else pa.float64())

    def both(key, mine: pa.Table, asked: pa.Table) -> pa.Table:
        return search(key, mine, asked) if mine.num_rows and asked.num_rows else none  # the side that a group lacks comes without columns

    return points.groupBy(*keys).cogroup(apart(queries).groupBy(*keys)).applyInArrow(both, _LISTS.format(kind))


def all_pairs(points: DataFrame, queries: DataFrame, n: int, asked: int, dim: int, k: int, kind: str, block: Callable) -> DataFrame:
    """Lists of the k best of all points for each query.

    ``points``: key, vec_id, vec, dim, spread (any number, to deal them by); ``queries``: query, own (a vec_id or NO_ID), vec, dim. Points
    are dealt to shards and queries to tiles of BLOCK_CELLS; each pair of a shard and a tile is a group. So a point is copied once for
    each tile and a query once for each shard, which is the least that blocks of this size allow. Few rows are dealt to more shards,
    for the sake of the cores. ``block(queries, points, ids, own)`` gives best_of_block's result.
    """
    rows = max(1024, BLOCK_CELLS // max(1, dim))
    shards = max(-(-n // rows), min(queries.sparkSession.sparkContext.defaultParallelism, -(-n // 2048)), 1)
    tiles = max(1, -(-asked // rows))
    dealt = points.withColumn("shard", F.pmod("spread", F.lit(shards))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).drop("spread")
    tiled = queries.withColumn("tile", F.pmod(F.xxhash64("query"), F.lit(tiles)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(key, mine: pa.Table, asked: pa.Table) -> pa.Table:
        ids, keys = mine["vec_id"].to_numpy(), mine["key"].to_numpy()
        row, place, score = block(matrix(asked["vec"]), matrix(mine["vec"]), ids, asked["own"].to_numpy())
        return lists(asked["query"].to_numpy(), key[2].as_py(), row, ids[place], keys[place], score)

    return cogrouped(dealt, tiled, ("dim", "tile", "shard"), search, kind)


def merged(parts: DataFrame, k: int, distinct: bool, fan_in: int = 64) -> DataFrame:
    """query and found, the k best (s, the negated score; i, the id; k, the key) from the lists of its blocks, by a tree of two levels.

    ``distinct``: entries that several blocks have are one.
    """
    entry = F.transform(F.arrays_zip("ids", "keys", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i"), x["keys"].alias("k")))
    found = parts.select("query", F.floor(F.col("part") / fan_in).alias("part"), entry.alias("found"))
    for keys in (["query", "part"], ["query"]):
        joined = F.flatten(F.collect_list("found"))
        found = found.groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(joined) if distinct else joined), 1, k).alias("found"))
    return found
