"""Phrases against counting in plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accordance.llm import collocations, queries

SCHEMA = "doc_id long, lang string, text string"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, longest=5):
    """Of rows (doc_id, lang, text)."""
    f, total = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_FOLD)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: n for p, n in f.items() if n >= least and len(p[1]) > 1}
    inside = {(lang, w[i : i + k]) for (lang, w), n in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if f[lang, w[i : i + k]] == n}
    scored = {}
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            scored.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, x in scored.items() for rank, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def found(spark, rows, **more):
    return sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA), **more).collect())


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "a", "of", "New", "york", "TIMES", "é", "中", "x-y", "a b c", "of the", "\0", " "]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", " \x0b"]
    return [(k, rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 80)))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rows = made(seed) + [(1, "en", None), (2, "en", ""), (3, "fr", " . "), (4, "en", "the a of"), (4, "en", "the a of")]
    assert found(spark, rows, least=4) == brute(rows, 4)
    assert found(spark, rows, least=3, top=3, longest=4) == brute(rows, 3, 3, 4)


def test_parts_of_long_texts(spark, monkeypatch):
    """Tiny chunks: texts are counted in overlapping parts, also where words are longer than a chunk."""
    monkeypatch.setattr(collocations, "CHUNK", 7)
    rng = random.Random(5)
    for k in (1, 2, 3, 5):
        for _ in range(300):
            text = "".join(rng.choice(["a", "bb", "longer-than-a-chunk", ".", " ", "  ", "\n"]) for _ in range(rng.randint(0, 40))).encode()
            grams = lambda t: Counter(tuple(w[i : i + k]) for p in re.split(b"[.\n]", t) for w in [p.split()] for i in range(len(w) - k + 1))  # noqa: B023, E731
            assert sum((grams(p) for p in collocations._overlapping(text, k)), Counter()) == grams(text), text


def test_chunks_of_any_size(spark, monkeypatch):
    """Passes over tiny chunks, within one process: texts cut between pieces, and those whose pieces are too long."""
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choice(["a", "b", "c", "d.", "e\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(40)] + [("de", "a b c a b " * 30), ("en", "x" * 50), ("de", "a " * 200)]
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.\n]", text):
            w = piece.split()
            want.update((lang, " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))

    class Shared:
        value = b"\xff" * 64

    for size in (5, 40, 1000):
        monkeypatch.setattr(collocations, "CHUNK", size)
        got, left = Counter(), rows
        for k in range(2, 7):
            batch = pa.RecordBatch.from_arrays([pa.array([r[j] for r in left], pa.string()) for j in (0, 1)], names=["lang", "text"])
            out = [r for b in collocations._pass(k, 5, Shared)(iter([batch])) for r in b.to_pylist()]
            for r in out:
                if r["phrase"] is not None:
                    got[r["lang"], r["phrase"]] += r["n"]
            assert k == 6 or sum(r["n"] for r in out if r["phrase"] is None and r["rest"] is None) == sum(n for (_, p), n in want.items() if p.count(" ") == k - 1)
            left = [(r["lang"], r["rest"]) for r in out if r["rest"] is not None] if k > 2 and k < 6 else left
        assert got == want, size


def test_full_bit_map(spark, monkeypatch):
    """A map too small to rule anything out changes no result."""
    rows = made(3, 40)
    want = brute(rows, 3)
    monkeypatch.setattr(collocations, "_bit_map", lambda level, n: b"\xff" * 4096)
    assert found(spark, rows, least=3) == want


def test_bit_map(spark):
    level = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = collocations._bit_map(level, 5000)
    assert len(bits) * 8 == collocations.LEAST_BITS
    at = {r.h % (len(bits) * 8) for r in level.collect()}
    assert at == {8 * k + j for k, b in enumerate(bits) if b for j in range(8) if b >> j & 1}


def test_large_products(spark):
    rng = random.Random(7)
    rows = [(a := rng.randint(100, 10**12), a + rng.randint(0, 10**12), a + rng.randint(0, 10**12), rng.randint(10**13, 10**16)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, l long, r long, n long").withColumn("score", F.expr(collocations.SCORE)).collect()
    assert all(r.score == 1000 * r.a * r.n // (r.l * r.r) for r in got)


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0
    rows = made(4)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", n int, phrase string, a int")
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=4).collect()) == brute(rows, 4)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()]
    assert sorted(tuple(r) for r in queries.op12_phrases(spark, sf).collect()) == brute(rows, 100)
