"""Near duplicates by DartMinHash.

A text is a weighted set: its five-word shingles with their counts. Similarity is weighted Jaccard, the
sum of the smaller counts by the sum of the larger ones. Every element has a half-plane of weight and
rank into which darts fall as a Poisson process seeded by the element; those below the element's weight
count. A dart is hashed to one of K coordinates, which keeps its earliest dart: two texts agree at a
coordinate with a chance of exactly their similarity. Only darts earlier than about K ln K + 2K by the
text's weight are looked at; a text that leaves a coordinate empty is looked at twice as far.

Texts that agree in all coordinates of a band meet. Each meets its bucket's smallest text, the leader;
members of a leader's buckets are compared exactly, in blocks of bounded size. What a block doesn't
connect to its leader is compared with all its other members, and if the leader has several blocks also
with those of the others, a block of guests with a block at a time. So every two texts that share a bucket
and aren't of one class yet are compared; a pair is only left uncounted if its sizes, or how its shingles are spread over
a few thousand places, can't give the similarity. Shingles are compared by 64 bits. Classes are the components of the links.

Equal texts are one text from the start (by MD5); null texts are empty ones. Texts of one to four words
have one shingle, their words. Texts without words have none and equal only the same text. Null ids are
kept; a class takes its smallest id. Words are runs between white space, in lower case. Texts of any length are
compared whole. Every row is answered, repeated ones too; an empty table has no classes. Other columns aren't read, and
``without_near_duplicates`` gives them back under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.llm.storage import discard, staged
from accordance.llm.vectors import apart as fresh

SHINGLE, SIMILAR = 5, 0.8
#: 28 bands of 5 coordinates: texts of similarity 0.8 miss each other with a chance of 1.5e-5.
BANDS, ROWS = 28, 5
K = BANDS * ROWS
#: Bytes of shingles to a block of a leader's members.
BLOCK_BYTES = 16 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Above 0, below 1."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class _Hashes(dict):
    """64-bit hashes of the words that a task has met, up to a bound; what a task leaves would stay in the worker's memory."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of texts: text number, hash and count, ordered by these."""
    parts, ends = [], []
    for text in texts:
        words = text.lower().split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        ends.append(len(words))
    n = np.array(ends, dtype=np.int64)
    words = np.concatenate([*parts, np.zeros(SHINGLE, np.uint64)])
    stop = np.cumsum(n)
    joined = np.zeros(len(words) - SHINGLE, np.uint64)
    for k in range(SHINGLE):
        joined = joined * _ODD + words[k : len(words) - SHINGLE + k]
    text = np.repeat(np.arange(len(texts)), n)
    whole = np.arange(len(joined)) + SHINGLE <= stop[text] if len(text) else np.zeros(0, bool)
    for t in np.flatnonzero((n > 0) & (n < SHINGLE)):  # short texts: all words, and how many
        first = stop[t] - n[t]
        value = n[t : t + 1].astype(np.uint64)
        for k in range(first, stop[t]):
            value = value * _ODD + words[k]
        joined[first], whole[first] = value[0], True
    text, joined = text[whole], _mix(joined[whole])
    order = np.lexsort((joined, text))
    text, joined = text[order], joined[order]
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (joined[1:] != joined[:-1]))) if len(text) else np.zeros(0, np.int64)
    return text[new], joined[new], np.diff(np.append(new, len(text)))


def _throw(element: np.ndarray, weight: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Darts that count: which element each is of, its rank and its hash. ``until``: the latest rank, by element.

    The half-plane is cut in strips of weight 0-1, 1-2, 2-4, 4-8 and so on. In each the darts arrive one
    after another, after exponential gaps at the strip's width as rate.
    """
    low, width, strip = 0.0, 1.0, 0
    at = np.arange(len(element))
    while len(at):
        live, rank, n = at, np.zeros(len(at)), 0
        while len(live):
            dart = _mix(element[live] + np.uint64((int(_ODD) * (strip * 4096 + n + 1)) % 2**64))
            rank = rank - np.log(_uniform(dart)) / width
            near = rank < until[live]
            live, rank, dart = live[near], rank[near], dart[near]
            value = _mix(dart ^ _ODD)
            hit = low + width * _uniform(value) < weight[live] if low or (weight < 1).any() else slice(None)
            yield live[hit], rank[hit], _mix(value + _ODD)[hit]
            n += 1
        low, width, strip = low + width, max(1.0, low + width), strip + 1
        at = at[weight[at] > low]


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int = K) -> np.ndarray:
    """The earliest rank at each coordinate for each text; infinity everywhere for a text without elements."""
    out = np.full((n_texts, k), np.inf)
    weight = weight.astype(np.float64)
    total = np.bincount(text, weight, minlength=n_texts)
    open_, reach = total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    while open_.any():
        mine = open_[text]
        t, e, w = text[mine], element[mine], weight[mine]
        flat = out.reshape(-1)
        for at, rank, dart in _throw(e, w, reach[t]):
            np.minimum.at(flat, t[at] * k + (dart % np.uint64(k)).astype(np.int64), rank)
        open_ &= np.isinf(out).any(axis=1)
        reach *= 2
    return out


def _bands(ranks: np.ndarray) -> np.ndarray:
    bits, out = ranks.view(np.uint64).reshape(len(ranks), BANDS, ROWS), np.zeros((len(ranks), BANDS), np.uint64)
    for r in range(ROWS):
        out = _mix(out * _ODD + bits[:, :, r])
    return _mix(out + np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD).view(np.int64)


def _chunks(rows: pd.DataFrame, chars: int = 400_000) -> Iterator[pd.DataFrame]:
    total = rows["text"].str.len().cumsum().to_numpy() // chars
    for part in np.unique(total):
        yield rows[total == part]


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for part in _chunks(rows):
            text, element, count = shingles(part["text"].tolist())
            ranks = signatures(text, element, count, len(part))
            size = np.bincount(text, count, minlength=len(part)).astype(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "key": part["key"], "size": size, "bands": [b if n else [] for b, n in zip(_bands(ranks), size)]})
    _hashes.clear()


def _unit_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each shingle as often as it occurs, numbered: weighted Jaccard is plain Jaccard of these sets."""
    for rows in batches:
        for part in _chunks(rows):
            text, element, count = shingles(part["text"].tolist())
            first = np.repeat(np.cumsum(count) - count, count)
            units = _mix(np.repeat(element, count) + (np.arange(len(first)) - first).astype(np.uint64) * _ODD)
            owner = np.repeat(text, count)
            cut = np.searchsorted(owner, np.arange(len(part) + 1))
            yield pd.DataFrame({"tid": part["tid"], "units": [np.sort(units[a:b]).tobytes() for a, b in zip(cut, cut[1:])]})
    _hashes.clear()


class _Block:
    """Texts to be compared, and the classes found so far."""

    def __init__(self, tids: np.ndarray, units: list[bytes]):
        self.tids, self.sets = tids, [np.frombuffer(u, np.uint64) for u in units]
        self.sizes = np.array([len(s) for s in self.sets])
        self.root, self.edges = np.arange(len(tids)), []
        self.ends = np.cumsum(self.sizes)
        every = np.concatenate(self.sets)
        # how many units each text has at each of some places: two share at most the smaller numbers' sum
        places = min(1 << 13, 1 << int(np.mean(self.sizes)).bit_length())
        at = np.repeat(np.arange(len(tids)), self.sizes) * places + (every & np.uint64(places - 1)).astype(np.int64)
        spread = np.bincount(at, minlength=len(tids) * places)
        self.spread = spread.astype(np.uint16 if spread.max(initial=0) < 1 << 16 else np.uint32).reshape(len(tids), places)
        names, self.ids = np.unique(every, return_inverse=True)
        self.own = np.zeros(len(names), dtype=bool)

    def shared(self, a: int, among: np.ndarray) -> np.ndarray:
        """How many units of text a each text of ``among`` has."""
        mine = self.ids[self.ends[a] - self.sizes[a] : self.ends[a]]
        self.own[mine] = True
        if len(among) * 8 < len(self.sets):
            found = np.array([np.count_nonzero(self.own[self.ids[self.ends[b] - self.sizes[b] : self.ends[b]]]) for b in among], dtype=np.int64)
        else:
            before = np.append(0, np.cumsum(self.own[self.ids]))
            found = before[self.ends[among]] - before[self.ends[among] - self.sizes[among]]
        self.own[mine] = False
        return found

    def most(self, a: int, among: np.ndarray) -> np.ndarray:
        """How many units of text a each text of ``among`` can have."""
        found, mine, step = np.zeros(len(among), dtype=np.int64), self.spread[a], max(1, (1 << 22) // self.spread.shape[1])
        for k in range(0, len(among), step):
            found[k : k + step] = np.minimum(self.spread[among[k : k + step]], mine).sum(axis=1, dtype=np.int64)
        return found

    def compare(self, a: int, among: np.ndarray) -> None:
        """Links text a with the texts ``among`` that are similar and not yet of its class."""
        among = among[self.root[among] != self.root[a]]
        small = np.minimum(self.sizes[among], self.sizes[a])
        among = among[small * (1 + 1e-9) >= SIMILAR * np.maximum(self.sizes[among], self.sizes[a])]
        among = among[(1 + SIMILAR) * (1 + 1e-9) * self.most(a, among) >= SIMILAR * (self.sizes[among] + self.sizes[a])]
        both = self.shared(a, among)
        for b in among[both >= SIMILAR * (self.sizes[a] + self.sizes[among] - both)]:
            if self.root[a] != self.root[b]:
                self.edges.append((self.tids[a], self.tids[b]))
                self.root[self.root == self.root[b]] = self.root[a]


_EDGES = "leader long, a long, b long"
_PAIR = ("leader", "block", "part")


def _within(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a block; and, with b null, the texts that it doesn't connect to its leader."""
    rows = rows.drop_duplicates("tid").sort_values("tid")
    leader = rows["leader"].iloc[0]
    block = _Block(rows["tid"].to_numpy(), rows["units"].tolist())
    everyone = np.arange(len(rows))
    first = int(np.flatnonzero(block.tids == leader)[0]) if (block.tids == leader).any() else 0
    block.compare(first, everyone)
    for a in everyone:
        if block.root[a] != block.root[first]:
            block.compare(a, everyone)
    apart = block.tids[block.root != block.root[first]] if rows["blocks"].iloc[0] > 1 else []
    found = [(a, b) for a, b in block.edges] + [(a, None) for a in apart]
    return pd.DataFrame({"leader": leader, "a": [a for a, _ in found], "b": pd.array([b for _, b in found], dtype="Int64")})


def _across(key, rows: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
    """Links of a block's texts with a part of those left over in other blocks."""
    made = pd.DataFrame({"leader": pd.Series(dtype="int64"), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64")})
    if rows.empty or guests.empty:
        return made
    both = pd.concat([rows, guests])
    block = _Block(both["tid"].to_numpy(), both["units"].tolist())
    home = np.arange(len(rows))
    for a in range(len(rows), len(both)):
        block.compare(a, home)
    return pd.DataFrame({"leader": key[0], "a": [a for a, _ in block.edges], "b": pd.array([b for _, b in block.edges], dtype="Int64")}) if block.edges else made


def _bytes(size: Column) -> Column:
    return F.sum(8 * size + 200)


def _home(blocks: Column) -> Column:
    """The block of a leader's member."""
    return F.pmod(F.xxhash64("tid"), blocks).cast("int")


def _pairs(full: DataFrame, apart: DataFrame, blocks: DataFrame, sets: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts at home and guests of each ``_PAIR``: a block of a leader, and a part of the texts left over in its other blocks.

    The leftovers are dealt to parts of BLOCK_BYTES too, so neither side of a pair grows with the leader's group.
    """
    parts = apart.join(texts.select("tid", "size"), "tid").groupBy("leader").agg(F.ceil(_bytes(F.col("size")) / BLOCK_BYTES).cast("int").alias("parts"))
    homes = full.join(parts, "leader").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    guests = apart.join(blocks, "leader").join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("tid", F.lit(1)), "parts").cast("int")).drop("parts")
    guests = guests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("block") != _home(F.col("blocks")))
    return homes, guests.join(sets, "tid")


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of ``edges`` (a, b), by large and small stars.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then the smaller ones;
    a few rounds make stars of all components. Rounds are written, so none is computed twice, and a round's
    table goes when the next one is there.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = staged(now, "edges"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, staged(small.distinct(), "edges")
        discard(before)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _row_key() -> Column:
    return F.concat_ws(":", F.hex("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (of its text), class_id (the class's smallest doc_id) and kept, for every row.

    The row kept of each class is the one with that doc_id; if several rows share it and the text, each is kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = staged(rows.mapInPandas(_sign, "doc_id long, key binary, size long, bands array<long>"), "signatures")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = staged(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    banded = texts.select("tid", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("tid").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = staged(banded.join(buckets, "band").where("tid <> leader").select("leader", "tid").distinct(), "members")
    sizes = members.join(texts.select("tid", "size"), "tid")
    blocks = sizes.groupBy("leader").agg(F.ceil(_bytes(F.col("size")) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = members.join(blocks, "leader").withColumn("block", _home(F.col("blocks")))
    dealt = dealt.select("leader", "tid", "blocks", "block").union(blocks.select("leader", F.col("leader").alias("tid"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))

    wanted = members.select("tid").union(members.select("leader")).distinct().join(texts.select("tid", "key", "doc_id"), "tid").select("tid", _row_key().alias("row"))
    found = rows.select(_row_key().alias("row"), "text").join(wanted, "row").groupBy("row", "tid").agg(F.first("text").alias("text"))
    sets = found.select("tid", "text").mapInPandas(_unit_sets, "tid long, units binary")
    sets = staged(sets, "sets")

    full = dealt.join(sets, "tid")
    links = staged(full.groupBy("leader", "block").applyInPandas(_within, _EDGES), "links")
    apart = links.where("b is null").select("leader", F.col("a").alias("tid"))
    edges = links.where("b is not null").select("a", "b")
    if not apart.isEmpty():
        homes, guests = _pairs(full, apart, blocks, sets, texts)
        more = homes.groupBy(*_PAIR).cogroup(fresh(guests).groupBy(*_PAIR)).applyInPandas(_across, _EDGES)
        edges = edges.union(more.select("a", "b"))

    rooted = texts.select("tid", "key", "doc_id").join(components(edges), F.col("tid") == F.col("node"), "left").select("tid", "key", "doc_id", F.coalesce("root", "tid").alias("root"))
    chief = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("tid").alias("tid"))).alias("chief"))
    known = rooted.join(chief, "root").select("key", F.col("doc_id").alias("least"), F.col("chief.doc_id").alias("class_id"), (F.col("tid") == F.col("chief.tid")).alias("chief"))
    return signed.select("doc_id", "key").join(known, "key").select("doc_id", "key", "class_id", (F.col("chief") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the smallest doc_id. Of rows with one id and text any one stays."""
    kept = staged(classes(docs, text).where("kept").groupBy(_row_key().alias("_row")).count(), "kept")
    row = F.concat_ws(":", F.hex(_key(text)), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))).alias("_row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), row)  # so that no name of ours meets one of the table's
    once = rows.join(kept.where("count = 1").select("_row"), "_row", "left_semi")
    repeated = kept.where("count > 1").select("_row")
    if not repeated.isEmpty():  # the same id and text in several rows
        once = once.unionByName(rows.join(repeated, "_row", "left_semi").dropDuplicates(["_row"]))
    return once.select("doc.*")
