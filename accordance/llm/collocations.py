"""Phrases whose words stand together more often than chance has it, mined level by level.

The first pass over the texts counts words, each later one phrases of one more word. A phrase is counted only where the two
phrases of one word less that overlap in it are frequent, which a pass knows from a broadcast bit map of the level before.
A level is counted by 64-bit hashes first, which shuffles little; the next pass counts those that came out frequent by their
text. So hashes that meet, and what the bit map lets through by chance, are counted too and then dropped for their count:
the map's size, which is bounded, never changes a result. From the third pass on only those runs of words are read again in
which a longer phrase can be. Counts are made in chunks of texts first and then by Spark. Scores come from joins of the
levels' tables: a phrase is cut after each of its words, and the weakest cut counts.

Texts are cut in pieces at ``.,;:!?`` and line ends, pieces in words at spaces and tabs; A-Z count as a-z. Everything is for
each language by itself, a null one being ``und``; null texts are empty ones. Repeated rows count each. Very long texts are
counted in parts, cut between pieces; if a piece is too long, in parts that overlap by the words a phrase needs. An empty
table has no phrases. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.llm.storage import staged

#: Bits of a map for each phrase in it, and of a map at least and at most (128 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Bytes of texts that are counted at once.
CHUNK = 2 << 20
#: Bits to a row that bitmap_construct_agg makes.
_ROW_BITS = 32768
#: What follows a word: spaces within a piece, or what ends the piece.
_SPACES, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACES)], _KIND[list(_BREAKS)] = 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_END = re.compile(b"[.,;:!?\n\x0b\x0c\r]")
_FOUND = "lang string, phrase string, h long, n long, rest string"

#: Of a, l, r and n; in decimals, since the products pass 64 bits.
SCORE = "(cast(1000 as decimal(4,0)) * (cast(a as decimal(15,0)) * cast(n as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _cut(text: bytes) -> list[bytes] | None:
    """A text in parts of about CHUNK bytes, cut between pieces; none if a piece is too long for that."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        end = _END.search(text, at + CHUNK, at + 2 * CHUNK)
        if end is None:
            if len(text) - at <= 2 * CHUNK:
                break
            return None
        out.append(text[at : end.start()])
        at = end.end()
    return [*out, text[at:] if at else text]


def _overlapping(text: bytes, k: int) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, each beginning k - 1 words before the end of the one before: no phrase of k words is lost or twice in them."""
    at, reach = 0, CHUNK
    while len(text) - at > reach:
        end = next((p for p in range(at + reach, len(text)) if _KIND[text[p]]), len(text))
        head = text[at:end]
        for _ in range(k - 1):
            head = head.rstrip(_SPACES + _BREAKS)
            head = head[: 1 + max(map(head.rfind, map(bytes, zip(_SPACES + _BREAKS))))]
        if end == len(text):
            break
        if not head:  # all of it words that the next part needs
            reach = end - at + CHUNK
            continue
        yield text[at:end]
        at, reach = at + len(head), CHUNK
    yield text[at:] if at else text


def _chunks(batch: pa.RecordBatch, k: int) -> Iterator[tuple[list[bytes], list[str], int | None]]:
    """Texts and their languages, about CHUNK bytes at a time, and None; a part of a text with a very long piece comes alone, with its number."""
    texts, langs, held = [], [], 0
    for lang, text in zip(batch["lang"].to_pylist(), pc.ascii_lower(batch["text"]).cast(pa.large_binary() if pa.types.is_large_string(batch["text"].type) else pa.binary())):
        text = text.as_py()
        parts = _cut(text)
        if parts is None:
            for number, part in enumerate(_overlapping(text, k)):
                yield [part], [lang], number
            continue
        for part in parts:
            texts.append(part)
            langs.append(lang)
            held += len(part)
            if held >= CHUNK:
                yield texts, langs, None
                texts, langs, held = [], [], 0
    if texts:
        yield texts, langs, None


def _table(**columns) -> pa.RecordBatch:
    """A batch of the result; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    kinds = {"lang": pa.string(), "phrase": pa.string(), "h": pa.int64(), "n": pa.int64(), "rest": pa.string()}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))


def _text(words: pa.Array) -> pa.Array:
    return words.cast(pa.large_string()).cast(pa.string())


class _Words:
    """The words of a chunk in their order: which piece each is in, and its number among the chunk's different words of a language."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = b"\n".join([*texts, b""])
        kind = _KIND[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False)).astype(np.int64)
        self.n = len(edges) // 2
        if not self.n:
            return
        starts = edges[::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.names = names.tolist()
        lang = code[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")]
        runs = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])  # words and what is between them
        runs = runs.dictionary_encode()
        of = runs.indices.to_numpy()[::2].astype(np.int64) * len(names) + lang
        if len(runs.dictionary) * len(names) <= 4 * len(of) + (1 << 20):
            some = np.flatnonzero(np.bincount(of))
            place = np.zeros(some[-1] + 1, np.int64)
            place[some] = np.arange(len(some))
            self.of = place[of]
        else:
            some, self.of = np.unique(of, return_inverse=True)
        self.word, self.lang = some // len(names), some % len(names)
        self.text = runs.dictionary
        self.hash = self._hashes()[self.word] ^ _mix(self._hashes(self.names))[self.lang]

    def _hashes(self, texts: list[str] | None = None) -> np.ndarray:
        """Of each different text: its bytes as the digits of a number in base _ODD, in 64 bits."""
        column = self.text if texts is None else pa.array(texts, pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
        size = np.diff(ends)
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(size.max(initial=1)), _ODD)))
        at = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)
        sums = np.append(np.uint64(0), np.cumsum(data * powers[at]))
        return sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]

    def phrases(self, begin: np.ndarray, k: int, raw: np.ndarray) -> pa.RecordBatch:
        """The different phrases of k words that begin at these places, with their hashes, and how often each does."""
        key, top, count = self.of[begin], len(self.word), len(self.word)
        for j in range(1, k):
            if top > (1 << 62) // count:
                some, key = np.unique(key, return_inverse=True)
                top = len(some)
            key, top = key * count + self.of[begin + j], top * count
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        first = begin[first]
        words = [self.text.take(pa.array(self.word[self.of[first + j]])) for j in range(k)]
        phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", words[0].type))
        lang = pa.array(self.names, pa.string()).take(pa.array(self.lang[self.of[first]]))
        return _table(lang=lang, phrase=_text(phrase), h=pa.array(_mix(raw[first]).view(np.int64)), n=pa.array(n.astype(np.int64)))

    def rest(self, begin: np.ndarray, k: int) -> pa.RecordBatch:
        """Of each language the runs of words that phrases of k words, which begin at these places, cover, a line each."""
        covered = np.zeros(self.n + 1, np.int32)
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + k, -1)
        at = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        lang = self.lang[self.of[at]]
        new = np.append(True, (np.diff(at) > 1) | (np.diff(self.piece[at]) != 0))
        starts = np.flatnonzero(new)
        order = np.argsort(lang[starts], kind="stable")
        joined = lambda first, n, texts, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), texts), by)
        lines = joined(starts, len(at), _text(self.text.take(pa.array(self.word[self.of[at]]))), " ")
        code, first = np.unique(lang[starts][order], return_index=True)
        texts = joined(first, len(order), lines.take(pa.array(order)), "\n")
        return _table(lang=pa.array(self.names, pa.string()).take(pa.array(code)), rest=texts)


def _pass(k: int, longest: int, shared) -> Callable:
    """Counts the phrases of k words by hash, as rows without a phrase, and those of k - 1 that the shared bit map has by text."""

    def chunk(texts: list[bytes], langs: list[str], number: int | None, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        words = _Words(texts, langs)
        if not words.n:
            return
        if k == 1:
            n = np.bincount(words.of)
            yield _table(h=pa.array(_mix(words.hash).view(np.int64)), n=pa.array(n))
            total = np.bincount(words.lang, n, minlength=len(words.names)).astype(np.int64)
            yield _table(lang=pa.array(words.names, pa.string()), phrase=pa.array([""] * len(total)), n=pa.array(total))
            return
        if words.n < k - 1:
            return
        each = words.hash[words.of]
        raw = each[: words.n - k + 2].copy()
        for j in range(1, k - 1):
            raw = raw * _ODD + each[j : j + len(raw)]
        at = _mix(raw) & np.uint64(len(bits) * 8 - 1)
        known = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        del at
        known &= words.piece[: len(raw)] == words.piece[k - 2 :]
        begin = np.flatnonzero(known)
        if number:  # the first one is the last of the part before
            begin = begin[begin > 0]
        if len(begin):
            yield words.phrases(begin, k - 1, raw)
        if k > longest:
            return
        begin = np.flatnonzero(known[:-1] & known[1:] & (words.piece[: len(raw) - 1] == words.piece[k - 1 :]))
        if len(begin):
            h, n = np.unique(_mix(raw[begin] * _ODD + each[begin + k - 1]), return_counts=True)
            yield _table(h=pa.array(h.view(np.int64)), n=pa.array(n.astype(np.int64)))
            if k > 2 and number is None:
                yield words.rest(begin, k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8) if shared else None
        for batch in batches:
            for texts, langs, number in _chunks(batch, k):
                yield from chunk(texts, langs, number, bits)  # what it has made goes before the next one is begun
            if 2 < k <= longest:  # texts that overlapping parts were made of are read whole again
                for row in np.flatnonzero(pc.greater(pc.binary_length(batch["text"]), CHUNK).to_numpy(zero_copy_only=False)).tolist():
                    if _cut(batch["text"][row].as_py().encode()) is None:
                        yield _table(lang=batch["lang"].slice(row, 1).cast(pa.string()), rest=batch["text"].slice(row, 1).cast(pa.string()))

    return count


def _bit_map(level: DataFrame, n: int) -> bytes:
    """The level's phrases in a bit map, by their hashes; made on the executors, in rows of 4 KB. Its size has a bound."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_EACH).bit_length()))
    at = F.pmod("h", F.lit(bits)) + 1
    rows = level.groupBy(F.bitmap_bucket_number(at).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    whole = bytearray(bits // 8)
    for r in rows.toLocalIterator():
        begin = (r.row - 1) * _ROW_BITS // 8
        whole[begin : begin + _ROW_BITS // 8] = r.bits
    return bytes(whole)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """Tables of the words, the pairs of words and so on (lang, phrase, n) that occur ``least`` times or more; the words'
    has for each language the number of all words, under the empty phrase."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    levels: list[DataFrame] = []
    hashes = None
    for k in range(1, longest + 2):
        shared = spark.sparkContext.broadcast(_bit_map(hashes, hashes.count())) if k > 1 else None
        found = rows.mapInArrow(_pass(k, longest, shared), _FOUND)
        if 2 < k <= longest:
            found = staged(found, f"pass{k}")
            rows = found.where("rest is not null").select("lang", F.col("rest").alias("text"))
        sums = found.where("rest is null").groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))
        sums = staged(sums.where((F.col("n") >= least) | (F.col("phrase") == "")), f"phrases{k}")
        hashes = sums.where("phrase is null")
        if k == 1:
            totals = sums.where("phrase = ''").select("lang", "phrase", "n")
        else:
            levels.append(sums.where("phrase is not null").select("lang", "phrase", "n"))
    return [levels[0].unionByName(totals), *levels[1:]]


def _joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, top: int = 2000, longest: int = 5, least: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language.

    Of a phrase that occurs a times, its best-known cut gives l and r, how often its two parts occur; n words are in all. The
    score is floor(1000 a n / (l r)), the lowest of the cuts', the shortest first part of equal ones. Phrases are left out
    that never occur but in one longer frequent phrase. Order: score and a descending, then the phrase.
    """
    levels = frequent_phrases(docs, longest, least, text, lang)
    known = levels[0].select("lang", "phrase", "n")
    for level in levels[1:]:
        known = known.unionByName(level.select("lang", "phrase", "n"))
    words = F.split("phrase", " ")
    found = known.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))

    size = F.size("words")
    inner = found.where(size > 2).select("lang", F.explode(F.array(_joined(F.col("words"), 1, size - 1), _joined(F.col("words"), 2, size - 1))).alias("phrase"), "a")
    kept = found.join(inner, ["lang", "phrase", "a"], "left_anti")

    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.col("words"), 1, F.col("cut")).alias("first"), _joined(F.col("words"), F.col("cut") + 1, size - F.col("cut")).alias("rest"))
    part = lambda name, count: known.where("phrase <> ''").select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    total = known.where("phrase = ''").select("lang", "n")
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"), F.first("a").alias("a"), F.first("n").alias("n"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
