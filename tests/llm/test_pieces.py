"""Encoding and decoding of pieces against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from accordance.llm import pieces, queries
from accordance.llm.encoding import CHUNK_CHARS, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   a", "a   ", "\n \n", "<s>", "</s> <0x41>", "▁", "a▁ b", "▁▁x ▁", "\0", "a\0b", "x²y", "ế 中文 😀", "é ​", " leading", "tail ", "a b"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts(lib):
    codec, rng = pieces.codec(PATH), random.Random(3)
    letters, names = "aabcdeehilnorst  \n\t▁.,'0123456789éüßñ中文字😀́​\x00벨ゼ  <s>İ", list(codec.scores)
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(names).replace("▁", " ") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode(texts)):
        want = lib.encode(text)
        assert ids.tolist() == want, text
        assert codec.decode(ids.tolist()) == lib.decode(want) == b"".join(codec.decoded(ids)).decode()


def test_decoding_of_any_ids(lib):
    codec, rng = pieces.codec(PATH), random.Random(4)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), 28705, rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_long_texts(lib):
    """Of many words, over the size of a part, and one without a space."""
    rng = random.Random(5)
    words = ["the", "thatrent.\nThese", "a  b", "über", "x" * 50, "中文"]
    many = " ".join(rng.choice(words) for _ in range(CHUNK_CHARS // 8))
    one = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    assert len(many) > CHUNK_CHARS
    for text, ids in zip((many, one), pieces.PieceCodec(PATH).encode([many, one])):
        assert ids.tolist() == lib.encode(text)


def test_forgetting(lib, monkeypatch):
    """What is remembered is bounded and forgotten without a change of results."""
    for name, most in (("MAX_PAIRS", 50), ("MAX_RUNS", 20)):
        monkeypatch.setattr(pieces, name, most)
    codec, rng = pieces.PieceCodec(PATH), random.Random(6)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(200)]
    for _ in range(2):
        assert [ids.tolist() for ids in codec.encode(texts)] == lib.encode(texts)


def test_query(spark, lib):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op13_sentence_pieces(spark, sf).collect():
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids))))


def test_odd_rows(spark, lib):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "a b", "y"), (7, None, "z"), (7, None, "z"), (1, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256) for r in pieces.piece_digests(docs).collect())
    want = []
    for k, t, _ in rows:
        ids = lib.encode(t or "")
        want.append((-1 if k is None else k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.piece_digests(docs.where("false")).count() == 0


def test_columns(spark, lib):
    """ids and texts as columns, and back."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(99, None)], "k int, text string")
    got = docs.withColumn("ids", pieces.encode_pieces()(F.col("text"))).withColumn("back", pieces.decode_pieces()(F.col("ids"))).collect()
    for r in got:
        assert np.array_equal(r.ids, lib.encode(r.text or "")) and r.back == lib.decode(r.ids)
    nothing = docs.select(pieces.decode_pieces()(F.lit(None).cast("array<int>")).alias("t"))
    assert {r.t for r in nothing.collect()} == {None}
