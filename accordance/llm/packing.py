"""Best-fit packing of token sequences after Martello and Toth's dominance reduction.

Documents longer than a sequence are cut; the pieces have lengths from 0 to the capacity. The plan
needs only how many pieces there are of each length, so its size depends on the capacity, not on
the number of documents: it is made on the driver from that histogram, as runs "the pieces of this
length with these ranks lie in sequences from this one on, at this offset". Ranks come from a
window in salted groups, so no length, however frequent, meets in one task.

Null and empty texts give one piece (the end id). Repeated rows and null ids are packed each for itself; which of them
comes first is left open. An empty table gives no rows. Other columns of the documents aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordance.llm.encoding import encoder, tokenizer_path
from accordance.llm.storage import staged

#: Length, first rank, first sequence, offset, how many pieces: one in each of so many sequences.
Run = tuple[int, int, int, int, int]
#: Rows of one length for each salt.
SALT_ROWS = 200_000
#: Runs of a plan have four numbers; this bounds what is broadcast (32 MB). A plan has a few runs for each length. More are joined.
MAX_RUNS = 1_000_000
#: Ranks to a key of that join.
RANKS = 256


class _Stock:
    """How many pieces of each length are left, and the first rank of each that isn't used yet."""

    def __init__(self, counts: dict[int, int]):
        self.left = {size: n for size, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.rank: dict[int, int] = defaultdict(int)

    def take(self, size: int, n: int) -> int:
        first = self.rank[size]
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.remove(size)
        return first

    def partner(self, size: int, room: int) -> int | None:
        """The largest piece of at most ``room`` besides one of ``size``."""
        at = bisect.bisect_right(self.sizes, room) - 1
        if at >= 0 and self.sizes[at] == size and self.left[size] == 1:
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def smallest(self, size: int, n: int) -> float:
        """The sum of the n smallest pieces besides one of ``size``; infinite without so many."""
        rest: list[int] = []
        for s in self.sizes[: n + 1]:
            rest += [s] * min(n, self.left[s] - (s == size))
        return sum(rest[:n]) if len(rest) >= n else float("inf")

    def best_pair(self, size: int, room: int) -> int:
        """The largest sum within ``room`` of two pieces besides one of ``size``; 0 without any."""
        best, high = 0, bisect.bisect_right(self.sizes, room) - 1
        left = lambda s: self.left[s] - (s == size)
        for low, s in enumerate(self.sizes):
            while high >= low and (s + self.sizes[high] > room or left(self.sizes[high]) < 1 + (self.sizes[high] == s)):
                high -= 1
            if high < low:
                break
            if left(s) > 0:
                best = max(best, s + self.sizes[high])
        return best

    def above(self, size: int, least: int, room: int) -> bool:
        """If two pieces longer than ``least``, besides one of ``size``, fit in ``room``."""
        at, rest = bisect.bisect_right(self.sizes, least), []
        for s in self.sizes[at : at + 3]:
            rest += [s] * min(2, self.left[s] - (s == size))
        return len(rest) > 1 and rest[0] + rest[1] <= room


def _reduce(stock: _Stock, capacity: int) -> tuple[list[Run], int]:
    """Fixes sequences that dominate all others with their largest piece, until none does.

    For a piece j let k be the largest piece that fits beside it. If there is none, j lies alone. If j
    and k fill a sequence, or no two pieces fit beside j, then any other set with j can be changed for
    {j, k} and the pieces set free fit where k was: {j, k} is fixed, as often as there are such pieces.
    Where two pieces fit beside j but no three, {j, k} is fixed if k is as long as any two of them
    together; else {j, k, b}, with the longest b that still fits, if no two pieces both longer than b do:
    then of each other set with j one piece is at most k and the other at most b.
    """
    runs, bins, changed = [], 0, True
    while changed:
        changed = False
        for j in reversed(stock.sizes.copy()):
            while stock.left.get(j):
                chosen = _dominating(stock, j, capacity - j)
                if chosen is None:
                    break
                # as often as there are such pieces; what goes makes no new sets possible
                times = min(stock.left[s] // chosen.count(s) for s in chosen)
                at = 0
                for s in chosen:
                    runs.append((s, stock.take(s, times), bins, at, times))
                    at += s
                bins, changed = bins + times, True
    return runs, bins


def _dominating(stock: _Stock, j: int, room: int) -> list[int] | None:
    """The sizes of a set with j that dominates all others, j first, if one of at most three is known to."""
    k = stock.partner(j, room)
    if k is None:
        return [j]
    if k == room or stock.smallest(j, 2) > room:
        return [j, k]
    if stock.smallest(j, 3) <= room:
        return None
    if k >= stock.best_pair(j, room):
        return [j, k]
    stock.left[k] -= 1  # what fits beside both
    try:
        b = next((s for s in reversed(stock.sizes[: bisect.bisect_right(stock.sizes, room - k)]) if stock.left[s] - (s == j) > 0), None)
    finally:
        stock.left[k] += 1
    return [j, k, b] if b is not None and not stock.above(j, b, room) else None


def _best_fit(stock: _Stock, capacity: int, bins: int) -> tuple[list[Run], int]:
    """Best fit by decreasing length. Sequences with the same room are handled together: as many as are
    needed take as many pieces each as fit, which is what placing the pieces one by one does."""
    runs: list[Run] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    order: list[int] = []

    def leave(room: int, first: int, many: int) -> None:
        if many:
            if room not in rooms:
                bisect.insort(order, room)
            rooms.setdefault(room, []).append((first, many))

    for size in stock.sizes[::-1]:
        n, rank = stock.left[size], stock.rank[size]
        while n:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                room = order[at]
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, first, many = capacity, bins, -(-n // (capacity // size))
                bins += many
            each = room // size
            full = min(many, n // each)
            part = min(n - full * each, each) if full < many else 0
            for k in range(each):
                for start, times in ((first, full), (first + full, int(k < part))):
                    if times:
                        runs.append((size, rank, start, capacity - room + k * size, times))
                        rank += times
            n -= full * each + part
            leave(room - each * size, first, full)
            leave(room - part * size, first + full, int(part > 0))
            leave(room, first + full + (part > 0), many - full - (part > 0))
    return runs, bins


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs and the number of sequences, for so many pieces of each length from 1 to ``capacity``."""
    stock = _Stock(counts)
    fixed, bins = _reduce(stock, capacity)
    fitted, bins = _best_fit(stock, capacity, bins)
    return fixed + fitted, bins


def pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces; only longer documents are cut."""
    path = tokenizer_path(tokenizer)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for rows in batches:
            found = []
            for doc, ids in zip(rows["doc_id"], encoder(path).ids(rows["text"].tolist())):
                packed = ids.tobytes() + end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    piece = packed[at : at + 4 * capacity]
                    found.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            made = pd.DataFrame(found, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(cut, out)


def pack(items: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` (with a length of 1 to capacity) with sequence_id and offset. ``order``: what tells items apart, for stable ranks."""
    items = staged(items.drop("sequence_id", "offset", "_salt"), "pieces")
    histogram = {r[0]: r[1] for r in items.groupBy("length").count().collect()}
    if any(not 0 < size <= capacity for size in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    runs, _ = plan(histogram, capacity)
    salts = max(1, -(-max(histogram.values(), default=0) // SALT_ROWS))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    base = salted.groupBy("length", "_salt").count().withColumn("_base", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    ranked = salted.join(F.broadcast(base) if len(histogram) * salts <= 100_000 else base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)

    placed = _by_broadcast(ranked, runs, max(histogram.values(), default=0) + 1) if len(runs) <= MAX_RUNS else _by_join(ranked, runs)
    return placed.select(*items.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def _by_broadcast(ranked: DataFrame, runs: list[Run], stride: int) -> DataFrame:
    """``ranked`` (length, _rank) with _at, where each lies."""
    size, rank, first, offset = (np.array(x, dtype=np.int64) for x in zip(*(r[:4] for r in sorted(runs)))) if runs else [np.zeros(0, np.int64)] * 4
    shared = ranked.sparkSession.sparkContext.broadcast((size * stride + rank, rank, first, offset))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, ranks, firsts, offsets = shared.value
        at = np.searchsorted(keys, length.to_numpy() * stride + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + rank.to_numpy() - ranks[at], "offset": offsets[at]})

    return ranked.withColumn("_at", place("length", "_rank"))


def _by_join(ranked: DataFrame, runs: list[Run]) -> DataFrame:
    """As _by_broadcast, the runs being a table: cut at every RANKS ranks, they meet their pieces by length and block of ranks."""
    table = ranked.sparkSession.createDataFrame(pd.DataFrame(runs, columns=["length", "_from", "_first", "_offset", "_n"]))
    blocks = F.sequence(F.floor(F.col("_from") / RANKS), F.floor((F.col("_from") + F.col("_n") - 1) / RANKS))
    table = table.withColumn("_block", F.explode(blocks))
    met = ranked.withColumn("_block", F.floor(F.col("_rank") / RANKS)).join(table, ["length", "_block"])
    met = met.where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
    return met.withColumn("_at", F.struct((F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset")))


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, text: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, capacity, tokenizer, end_id, text), capacity)
