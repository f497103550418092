"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns the unit vectors;
the hash is the signed axis nearest to the result. Where there are many vectors a second rotation's
nearest axis, among its first ones, is joined to it, so that buckets become more as the table grows. Each
table has its own rotations; a query visits in each table the buckets of the axes nearest to it
(multiprobe). All that lies in a visited bucket is scored exactly, on the original vectors in double
precision, as products of blocks.

How many buckets are visited is measured: a few queries, at most ``sample`` a vector length, are compared
with all vectors, and as many probes are taken as find the share ``target`` of their true neighbours. So
vectors with near neighbours need few probes, and such without (random ones) many. Queries that find
fewer than k are compared with all vectors.

Where norms differ, vectors get one more component that makes them equally long and queries a zero there,
so that the largest inner product is again the nearest direction.

Equal vectors are one from the start, however many rows have them: of each the k + 1 smallest ids count
(with up to k repeated rows each), which is all that a query can find. Each repeated row is a candidate of
its own. A query finds no row of its own id; an id that several query rows have is answered once. Rows with
a null id or a null, empty, zero or non-finite vector take no part; vectors of another length than the
query's are no candidates. Other columns aren't read. Without queries, or rows, there are no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.llm.storage import staged
from accordance.llm.vectors import BLOCK_CELLS, NO_ID, all_pairs, best, best_of_block, cogrouped, lists, matrix, merged, taking_part

#: Vectors to a bucket, at which a second hash begins to divide them; buckets of a table, and groups they are gathered to, at most.
BUCKET_ROWS, MAX_BUCKETS, MAX_GROUPS = 512, 1 << 16, 1 << 14


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width)


class CrossPolytope:
    """``tables`` tables for about ``n`` vectors of ``dim`` components; ``longest``: their largest norm, if norms differ."""

    def __init__(self, dim: int, tables: int, n: int, seed: int, longest: float | None):
        self.tables, self.longest = tables, longest
        self.width = 1 << max(0, dim - 1 + (longest is not None)).bit_length()
        second = min(n // (2 * self.width * BUCKET_ROWS), MAX_BUCKETS // (2 * self.width), 2 * self.width)
        self.axes = [self.width] + ([1 << (second.bit_length() - 2)] if second >= 2 else [])
        self.buckets_a_table = int(np.prod([2 * a for a in self.axes]))
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, len(self.axes), 3, self.width))

    def _padded(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out = np.zeros((len(x), self.width))
        if self.longest is None or is_query:
            out[:, : x.shape[1]] = x / norm
        else:
            out[:, : x.shape[1]] = x / self.longest
            out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.longest) ** 2))
        return out

    def turned(self, x: np.ndarray, is_query: bool) -> list[list[np.ndarray]]:
        """For each table and each of its hashes, how near each signed axis is."""
        x, out = self._padded(x, is_query), []
        for table in self.signs:
            out.append([])
            for signs, axes in zip(table, self.axes):
                y = x
                for s in signs:
                    y = _hadamard(y * s) / np.sqrt(self.width)
                out[-1].append(np.concatenate([y[:, :axes], -y[:, :axes]], axis=1))
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t, hashes in enumerate(self.turned(x, False)):
            for y in hashes:
                out[:, t] = out[:, t] * y.shape[1] + y.argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n buckets of each table nearest to each query."""
        out = []
        for hashes in self.turned(x, True):
            score, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
            for y in hashes:
                axes = np.argpartition(-y, min(n, y.shape[1]) - 1, axis=1)[:, :n]
                score = (score[:, :, None] + np.take_along_axis(y, axes, 1)[:, None, :]).reshape(len(x), -1)
                bucket = (bucket[:, :, None] * y.shape[1] + axes[:, None, :]).reshape(len(x), -1)
                top = np.argpartition(-score, min(n, score.shape[1]) - 1, axis=1)[:, :n]
                score, bucket = np.take_along_axis(score, top, 1), np.take_along_axis(bucket, top, 1)
            out.append(bucket)
        return np.stack(out, axis=1)

    def needed(self, queries: list[list[np.ndarray]], who: np.ndarray, points: np.ndarray) -> np.ndarray:
        """How many probes of the query ``who`` find each point, in the table that finds it first; of equally near buckets, all. ``queries``: turned."""
        out = np.full(len(points), self.buckets_a_table)
        for asked, own in zip(queries, self.turned(points, False)):
            near = [q[who] for q in asked]
            at = [np.take_along_axis(q, y.argmax(axis=1)[:, None], 1) for q, y in zip(near, own)]
            if len(near) == 1:
                rank = (near[0] >= at[0] - 1e-9).sum(axis=1)
            else:
                both = np.sort(near[1], axis=1)
                left = at[0] + at[1] - near[0] - 1e-9
                rank = np.array([(len(b) - np.searchsorted(b, s)).sum() for b, s in zip(both, left)])
            out = np.minimum(out, rank)
        return out


def _of_length(table: pa.Table, dim: int) -> pa.Table:
    return table.filter(pc.equal(table["dim"], dim))


def _distinct(rows: DataFrame, hashers: dict[int, CrossPolytope], k: int) -> DataFrame:
    """A row for each different vector: v1 and v2 (which it is known by), did (its number), vec, dim, asked (if a query has it), buckets
    (one a table) and rows: the k + 1 smallest ids that have it, with their number of rows, k at most. Only ids and hashes are sorted."""
    counted = rows.groupBy("v1", "v2", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("v1", "v2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    copies = first.groupBy("v1", "v2").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("rows"))
    each = rows.groupBy("v1", "v2").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"), F.max("is_query").alias("asked"))
    shared = rows.sparkSession.sparkContext.broadcast(hashers)

    @F.pandas_udf("array<long>")
    def hashed(vec: pd.Series, dim: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vec), index=vec.index, dtype=object)
        for d in dim.unique():
            at = np.flatnonzero(dim.to_numpy() == d)
            out.iloc[at] = list(shared.value[d].buckets(np.stack(vec.iloc[at].tolist()).astype(np.float64)))
        return out

    made = each.join(copies, ["v1", "v2"]).withColumn("did", F.monotonically_increasing_id())
    return staged(made.withColumn("buckets", hashed("vec", "dim")), "vectors")


def _probes(vectors: DataFrame, hashers: dict[int, CrossPolytope], k: int, sample: int, target: float) -> dict[int, int]:
    """How many probes find the share ``target`` of the sample's k nearest vectors, by vector length."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("v1", "v2"))
    asked = vectors.where("asked").select("dim", "did", "vec", "v1", "v2").withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    chosen: dict[int, list] = {}
    for r in asked.collect():
        chosen.setdefault(r.dim, []).append((r.did, np.array(r.vec, dtype=np.float64)))
    turned = {d: hashers[d].turned(np.stack([v for _, v in q]), True) for d, q in chosen.items()}
    shared = vectors.sparkSession.sparkContext.broadcast((hashers, chosen, turned))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, chosen, turned = shared.value
        state: dict[int, tuple] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for d in chosen.keys() & set(table["dim"].to_pylist()):
                part = _of_length(table, d)
                x, own = matrix(part["vec"]).astype(np.float64), np.array([did for did, _ in chosen[d]])
                row, place, score = best_of_block(np.stack([v for _, v in chosen[d]]), x, part["did"].to_numpy(), own, k)
                found = row, hashers[d].needed(turned[d], row, x[place]), score
                row, need, score = (np.concatenate(c) for c in zip(found, *([state[d]] if d in state else [])))
                state[d] = best(row, need, score, k, need)
        for d, (row, need, score) in state.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(len(row), d), pa.int32()), "q": pa.array(row, pa.int32()), "need": pa.array(need, pa.int64()), "score": pa.array(score, pa.float64())})

    near = vectors.select("did", "vec", "dim").mapInArrow(measure, "dim int, q int, need long, score double")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("dim", "q").orderBy(F.desc("score"), "need"))).where(F.col("place") <= k)
    return {r.dim: int(r.need) for r in near.groupBy("dim").agg(F.percentile("need", F.lit(target)).alias("need")).select("dim", F.ceil("need").alias("need")).collect()}


def _search(vectors: DataFrame, hashers: dict[int, CrossPolytope], sizes: dict[int, int], probes: dict[int, int], k: int) -> DataFrame:
    """Lists of the best of each visited bucket. Buckets are gathered to groups, and groups of more than a block dealt to parts."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = {d: min(h.buckets_a_table, MAX_GROUPS, max(-(-4 * sizes.get(d, 0) * d // BLOCK_CELLS), cores)) for d, h in hashers.items()}
    number = F.create_map(*(F.lit(x) for d in groups for x in (d, groups[d])))[F.col("dim")]
    placed = vectors.select("did", "dim", "vec", F.col("rows")[0]["vec_id"].alias("vec_id"), F.posexplode("buckets").alias("table", "bucket")).withColumn("group", F.pmod("bucket", number))
    counts = placed.groupBy("dim", "table", "group").count().collect()  # of at most MAX_GROUPS groups a table
    parts = {(r.dim, r.table, r.group): -(-r["count"] * r.dim // BLOCK_CELLS) for r in counts}
    shared = vectors.sparkSession.sparkContext.broadcast((hashers, parts))

    @F.pandas_udf("array<struct<table:int,group:long,parts:int,buckets:array<long>>>")
    def visits(vec: pd.Series, dim: pd.Series) -> pd.Series:
        hashers, parts = shared.value
        out = pd.Series([None] * len(vec), index=vec.index, dtype=object)
        for d in dim.unique():
            rows = np.flatnonzero(dim.to_numpy() == d)
            found = []
            for begin in range(0, len(rows), 500):
                for each in hashers[d].probes(np.stack(vec.iloc[rows[begin : begin + 500]].tolist()).astype(np.float64), probes.get(d, 1)):
                    found.append([])
                    for t, buckets in enumerate(each):
                        group = buckets % groups[d]
                        for g in np.unique(group).tolist():
                            if (d, t, g) in parts:
                                found[-1].append({"table": t, "group": g, "parts": parts[d, t, g], "buckets": buckets[group == g]})
            out.iloc[rows] = found
        return out

    @F.pandas_udf("int")
    def part_of(dim: pd.Series, table: pd.Series, group: pd.Series, did: pd.Series) -> pd.Series:
        n = np.array([shared.value[1][key] for key in zip(dim, table, group)])
        return pd.Series(did.to_numpy() % n)

    points = placed.withColumn("part", part_of("dim", "table", "group", "did"))
    asked = vectors.where("asked").select(F.col("did").alias("query"), "vec", "dim", F.explode(visits("vec", "dim")).alias("v"))
    asked = asked.select("query", "vec", "dim", "v.table", "v.group", "v.buckets", F.explode(F.sequence(F.lit(0), F.col("v.parts") - 1)).alias("part"))

    def search(key, mine: pa.Table, asked: pa.Table) -> pa.Table:
        mine = mine.sort_by([("bucket", "ascending"), ("vec_id", "ascending"), ("did", "ascending")])
        x, q = (matrix(t["vec"]).astype(np.float64) for t in (mine, asked))
        ids, dids, bucket = mine["vec_id"].to_numpy(), mine["did"].to_numpy(), mine["bucket"].to_numpy()
        wants = asked["buckets"].combine_chunks()
        want, who = wants.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(wants.offsets.to_numpy()))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        none = np.full(len(q), NO_ID)
        for b in np.unique(want):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            if lo < hi:
                r = who[want == b]
                row, place, score = best_of_block(q[r], x[lo:hi], ids[lo:hi], none[r], k)
                found.append((r[row], place + lo, score))
        row, place, score = (np.concatenate(c) for c in zip(*found))
        row, place, score = best(row, ids[place], score, k, place)
        return lists(asked["query"].to_numpy(), hash(tuple(x.as_py() for x in key)) % 4096, row, ids[place], dids[place], score)

    return cogrouped(points, asked, ("dim", "table", "group", "part"), search, "double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 2, target: float = 0.96, sample: int = 100, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query, ties to smaller vec_id.

    ``vectors`` has vec_id and embedding; ``is_query`` says which rows are queries. ``target``: the share of the true neighbours
    of a sample that the probes are to find.
    """
    vec, wide = F.col("embedding"), F.col("embedding").cast("array<double>")
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        vec = wide
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.where(F.col("vec_id").isNotNull() & taking_part(wide) & (norm > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), vec.alias("vec"), F.size(vec).alias("dim"), norm.alias("norm"), F.xxhash64(vec).alias("v1"), F.xxhash64(vec, F.lit(1)).alias("v2")
    )
    shapes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high")).collect()  # one row a length
    hashers = {s.dim: CrossPolytope(s.dim, tables, s.n, seed, s.high if s.high > s.low * 1.001 else None) for s in shapes}
    if not hashers:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    each = _distinct(rows, hashers, k)
    sizes = {r.dim: (r.n, r.q) for r in each.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("int")).alias("q")).collect()}
    probes = _probes(each, hashers, k, sample, target)
    found = staged(merged(_search(each, hashers, {d: n for d, (n, _) in sizes.items()}, probes, k + 1), k + 1, distinct=True), "found")

    most = F.create_map(*(F.lit(x) for d, (n, _) in sizes.items() for x in (d, min(k + 1, n))))[F.col("dim")]
    got = found.select(F.col("query").alias("did"), F.size("found").alias("got"))
    short = staged(each.where("asked").select("did", "dim", "vec").join(got, "did", "left").where(F.coalesce("got", F.lit(0)) < most), "short")
    missed = short.count()
    if missed:
        points = each.select(F.col("did").alias("key"), F.col("rows")[0]["vec_id"].alias("vec_id"), "vec", "dim", F.col("did").alias("spread"))
        asked = short.select(F.col("did").alias("query"), F.lit(NO_ID).alias("own"), "vec", "dim")
        block = lambda q, x, ids, own: best_of_block(q.astype(np.float64), x.astype(np.float64), ids, own, k + 1)
        more = merged(all_pairs(points, asked, sum(n for n, _ in sizes.values()), missed, max(sizes), k + 1, "double", block), k + 1, distinct=False)
        found = found.join(short.select(F.col("did").alias("query")), "query", "left_anti").unionByName(more)
    return _answers(rows, each, found, k)


def _answers(rows: DataFrame, vectors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The vectors found for each different vector as the rows found for each query."""
    copies = vectors.where((F.size("rows") > 1) | (F.col("rows")[0]["n"] > 1)).select(F.col("did").alias("key"), "rows")
    flat = found.select("query", F.explode("found").alias("x")).select("query", F.col("x.s").alias("s"), F.col("x.i").alias("i"), F.col("x.k").alias("key"))
    flat = flat.join(copies, "key", "left").withColumn("rows", F.coalesce("rows", F.array(F.struct(F.col("i").alias("vec_id"), F.lit(1).cast("long").alias("n")))))
    found = flat.groupBy("query").agg(F.collect_list(F.struct("s", "rows")).alias("found"))
    asked = rows.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v1", "v2")).alias("v")).select("query_id", "v.v1", "v.v2")
    asked = asked.join(vectors.where("asked").select("v1", "v2", F.col("did").alias("query")), ["v1", "v2"])
    others = lambda f: F.filter(f["rows"], lambda r: r["vec_id"] != F.col("query_id"))
    listed = F.flatten(F.transform("found", lambda f: F.flatten(F.transform(others(f), lambda r: F.array_repeat(F.struct(f["s"].alias("s"), r["vec_id"].alias("i")), r["n"].cast("int"))))))
    ranked = asked.join(found, "query").select("query_id", F.posexplode(F.slice(F.array_sort(listed), 1, k)).alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
