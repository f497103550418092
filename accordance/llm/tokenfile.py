"""Token ids in binary files, with a minimal perfect hash index for access by key.

A folder holds payloads ``ids-N.bin`` (nothing but ids, little-endian, in ascending order of keys),
``ids-N.off`` (the offset of each document and of the end, 8 bytes each), and index files
``index-N.mph``. Keys are dealt to index files by hash. Each has a minimal perfect hash function (a
cascade of bit arrays: a key alone at its bit stays there, keys that meet go on to the next array;
its number is the count of bits before) and, in the order of those numbers, a fingerprint of each
key and where its documents lie. An access reads one place of one index file and one of a payload;
documents that are neighbours in a payload are read together.

Rows with a null key are kept under the null key, repeated keys under one entry for each payload file
that holds them; null texts are empty ones and consist of the end id. Texts of any length are encoded whole. Documents of
one key come in the order of their texts' hashes; equal rows each have a place. An empty table gives no files and no rows.
Other columns aren't read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordance.llm.encoding import encoder, tokenizer_path
from accordance.llm.storage import shared_dir, staged

#: Keys to an index file.
INDEX_KEYS = 250_000
#: Bytes of neighbouring documents that are read at once.
READ_BYTES = 8 << 20
_ENTRIES = "key long, shard int, first_doc long, n_docs long, first_token long, n_tokens long"
_LEVELS, _ROOM = 40, 2


def _fs(folder: str):
    """Any store that Arrow knows: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, chunks) -> None:
    """A file that appears whole or not at all, whichever attempt of a task writes it."""
    store, at = _fs(folder)
    store.create_dir(at, recursive=True)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(own, f"{at}/{name}")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash function of distinct 64-bit keys: number(keys) gives 0 to n-1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = np.cumsum([0, *(int(bits.sum()) for bits in levels)])
        self.ranks = [np.cumsum(bits, dtype=np.int64) - bits for bits in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels, keys = [], keys.astype(np.uint64)
        while len(keys) and len(levels) < _LEVELS:
            size = max(8, _ROOM * len(keys))
            at = (_mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels, np.sort(keys))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Any number, or -1, for a key that isn't one of the set."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out


def _hashes(key: str) -> list[Column]:
    """The hash that places a key, and the one whose bits are its fingerprint."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("fingerprint")).alias("h2")]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, writes payloads in ascending key order, and returns their entries (one for each key and file).

    Rows are dealt to files by ranges of the key and of the text's hash, so that one key's rows can
    fill several files. Ids take two bytes where the vocabulary fits.
    """
    path = tokenizer_path(tokenizer)
    dtype = "<u2" if encoder(path, "<u4").tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=dtype).tobytes()
        keys, sizes = [], []

        def ids():
            for rows in batches:
                keys.extend(None if pd.isna(k) else int(k) for k in rows["key"])
                for found in encoder(path, dtype).ids(rows["text"].tolist()):
                    sizes.append(len(found) + 1)
                    yield found.tobytes() + end

        stream = ids()
        first = next(stream, None)
        if first is None:
            return

        def chunks():
            yield first
            yield from stream

        _write(folder, f"ids-{shard:06d}.bin", chunks())
        starts = np.append(0, np.cumsum(sizes)).astype("<i8")
        _write(folder, f"ids-{shard:06d}.off", [starts.tobytes()])
        new = np.flatnonzero([True, *(a != b for a, b in zip(keys[1:], keys))])
        stop = np.append(new[1:], len(keys))
        yield pd.DataFrame({"key": pd.array([keys[k] for k in new], dtype="Int64"), "shard": shard, "first_doc": new, "n_docs": stop - new, "first_token": starts[new], "n_tokens": starts[stop] - starts[new]})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    return staged(ordered.mapInPandas(write, _ENTRIES), "entries")


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Writes the index files; returns their numbers, keys and bytes."""
    n_files = max(1, -(-entries.count() // INDEX_KEYS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h1", "h2", "shard"], kind="stable")
        place, mark = rows["h1"].to_numpy(), rows["h2"].to_numpy()
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (mark[1:] != mark[:-1])))
        # two keys with one first hash can't be told apart by it: they share a number, their entries lie together
        head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        found = PerfectHash.of(place[head].view(np.uint64))
        order = np.argsort(found.number(place[head].view(np.uint64)))
        counts = np.diff(np.append(head, len(rows)))[order]
        pick = np.concatenate([np.arange(head[k], head[k] + c) for k, c in zip(order, counts)]) if len(order) else np.array([], dtype=np.int64)
        columns = {c: rows[c].to_numpy()[pick] for c in ("shard", "first_doc", "n_docs", "first_token", "n_tokens")}
        out = io.BytesIO()
        np.savez(out, levels=np.array([len(b) for b in found.levels]), bits=np.packbits(np.concatenate([*found.levels, np.zeros(0, bool)])), rest=found.rest, begins=np.append(0, np.cumsum(counts)), fingerprint=mark[pick], **columns)
        number = int(rows["file"].iloc[0])
        _write(folder, f"index-{number:06d}.mph", [out.getvalue()])
        return pd.DataFrame({"file": [number], "n_keys": [len(new)], "n_bytes": [out.tell()]})

    keyed = entries.select("*", *_hashes("key")).withColumn("file", F.pmod(F.shiftright("h1", 32), F.lit(n_files)).cast("int"))
    return staged(keyed.groupBy("file").applyInPandas(build, "file int, n_keys long, n_bytes long"), "index")


def _index(folder: str, number: int):
    store, at = _fs(folder)
    with store.open_input_file(f"{at}/index-{number:06d}.mph") as file:
        data = np.load(io.BytesIO(file.read()))
        data = {k: data[k] for k in data.files}
    sizes = data["levels"].astype(int)
    bits = np.unpackbits(data["bits"], count=int(sizes.sum())).astype(bool)
    return PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [], data["rest"]), data


def look_up(keys: DataFrame, folder: str, n_files: int, key: str = "key") -> DataFrame:
    """The entries of each different key that the files hold; others have none."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        numbers, data = _index(folder, int(rows["file"].iloc[0]))
        at = numbers.number(rows["h1"].to_numpy().view(np.uint64))
        rows, at = rows[at >= 0], at[at >= 0]
        begin, stop = data["begins"][at], data["begins"][at + 1]
        pick = np.concatenate([np.arange(a, b) for a, b in zip(begin, stop)]) if len(at) else np.array([], dtype=np.int64)
        out = rows[["key", "h2"]].iloc[np.repeat(np.arange(len(rows)), stop - begin)].reset_index(drop=True)
        for c in ("shard", "first_doc", "n_docs", "first_token", "n_tokens"):
            out[c] = data[c][pick]
        return out[out["h2"].to_numpy() == data["fingerprint"][pick]].drop(columns="h2").astype({"key": "Int64"})

    dealt = keys.select(F.col(key).cast("long").alias("key")).distinct().select("*", *_hashes("key")).withColumn("file", F.pmod(F.shiftright("h1", 32), F.lit(n_files)).cast("int"))
    return dealt.groupBy("file").applyInPandas(find, _ENTRIES)


def _runs(docs: list[tuple], starts: np.ndarray) -> Iterator[list[tuple]]:
    """The documents (key, number), in order, in runs of neighbours of about READ_BYTES, to be read at once."""
    run: list[tuple] = []
    for key, doc in docs:
        if run and (doc > run[-1][1] + 1 or starts[doc + 1] - starts[run[0][1]] > READ_BYTES):
            yield run
            run = []
        run.append((key, doc))
    if run:
        yield run


def read_tokens(found: DataFrame, folder: str, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """The documents of entries: key, shard, offset (ids of the file before), n_tokens, ids_crc32 (over 4-byte ids), ids if asked for."""
    out = "key long, shard int, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(rows: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        store, at = _fs(folder)
        width, shard = np.dtype(dtype).itemsize, int(rows["shard"].iloc[0])
        with store.open_input_file(f"{at}/ids-{shard:06d}.off") as file:
            starts = np.frombuffer(file.read(), "<i8")
        rows, made = rows.sort_values("first_doc"), []
        docs = [(key, doc) for key, first, n in zip(rows["key"], rows["first_doc"], rows["n_docs"]) for doc in range(first, first + n)]
        with store.open_input_file(f"{at}/ids-{shard:06d}.bin") as file:
            for run in _runs(docs, starts * width):
                first, last = int(starts[run[0][1]]), int(starts[run[-1][1] + 1])
                ids = np.frombuffer(file.read_at((last - first) * width, first * width), dtype).astype("<u4")
                for key, doc in run:
                    begin, stop = int(starts[doc]), int(starts[doc + 1])
                    mine = ids[begin - first : stop - first]
                    made.append((key, shard, begin, stop - begin, zlib.crc32(mine.tobytes()), *([mine.astype(np.int32)] if with_ids else [])))
        names = ["key", "shard", "offset", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
        return pd.DataFrame(made, columns=names).astype({"key": "Int64"})

    return found.groupBy("shard").applyInPandas(read, out)


def encode_and_read(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as files with their index, then reads every document back through the index.

    doc_id, start (ids of all documents before it, in the files' order), n_tokens, ids_crc32.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    entries = write_tokens(docs, folder, tokenizer, end_id)
    n_files = max(1, write_index(entries, folder).count())
    dtype = "<u2" if encoder(tokenizer_path(tokenizer), "<u4").tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    read = read_tokens(look_up(docs, folder, n_files, "doc_id"), folder, dtype)
    shards = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    return read.join(shards.select("shard", "base"), "shard").select(F.col("key").alias("doc_id"), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
