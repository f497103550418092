"""The pipeline's stages against plain Python, on a small corpus with planted cases."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import _similarity, _tokenizer
from test_mixing_packing import brute

import corpus_pipeline
from accordance.llm import neardup, pii, storage, toxicity, urls
from accordance.llm.queries import WEIGHTS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("rest", "whole", "last", "row", "toxic", "score", "key", "class_id", "kept", "_row", "features", "held_out", "spans", "count", "tokens_", "tid")


def _corpus():
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(300)]
    rows, toxic = [], {}
    for k in range(160):
        text = ". ".join(" ".join(rng.choice(words, 12)) for _ in range(4))
        if k % 5 == 0:
            text, toxic[k] = text + ". you vile wretch", 1
        rows.append([k, text, ["en", "de", "fr", None][k % 4], f"src{k % 6}"])
    base = rows[1][1].split()
    rows += [[200 + k, " ".join([*base[:k], *base]), "en", "src1"] for k in (0, 0, 1, 2)]  # copies and near ones of document 1
    rows += [[300, rows[2][1] + " mail a.b@x.com or +45 12 34 56 78", "en", "src2"], [301, None, None, None], [302, "", "en", "src2"], [303, "same", "en", "src1"], [303, "same", "en", "src1"]]
    rows += [[304, " ".join(f"long{k}" for k in range(30_000)), "de", "src3"]]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, toxic = _corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, toxic.get(d, 0)) for d in range(160)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _key(rows):
    return sorted(map(repr, rows))


def test_toxicity_keeps_clean_documents(spark, folder):
    rows, toxic = _corpus()
    got = corpus_pipeline.drop_toxic(spark, _docs(spark, folder), folder)
    assert _key(map(tuple, got.collect())) == _key(r for r in rows if r[0] not in toxic)


def test_scores_against_plain_python(spark, folder):
    docs, labels = _docs(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    for r in toxicity.score_documents(docs, labels).collect():
        text = next(t for d, t, *_ in _corpus()[0] if d == r.doc_id) or ""
        odds = {(): model.bias}  # of each different set of known words; sentences without any are one
        for part in re.split(r"[.!?;:\n\r\u2028\u2029。！？]+", text.lower()):
            found = {f for w in part.split() for f in toxicity.features(w) if f in model.weights}
            odds[tuple(sorted(f for w in set(part.split()) for f in toxicity.features(w) if f in model.weights))] = model.bias + sum(model.weights[f] for w in set(part.split()) for f in toxicity.features(w) if f in found)
        chances = [1 / (1 + np.exp(-o)) for o in odds.values()]
        many = [p for p in chances if p >= 0.5] or [max(chances)]
        assert r.score == pytest.approx(1 - np.prod([1 - p for p in many]), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_near_duplicates_keep_one_of_each_class(spark, folder):
    rows, _ = _corpus()
    got = corpus_pipeline.drop_near_duplicates(spark, _docs(spark, folder), folder)
    texts = {d: t or "" for d, t, *_ in rows}
    root = {d: d for d in texts}
    short = [d for d in texts if len(texts[d]) < 5000]
    for a in short:
        for b in short:
            if a < b and root[a] != root[b] and (texts[a] == texts[b] or _similarity(texts[a], texts[b]) >= 0.8):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    want = {r for r in rows if root[r[0]] == r[0]}
    assert _key(map(tuple, got.collect())) == _key(want)  # 303 comes twice and stays once


def test_personal_data_is_replaced(spark, folder):
    rows, _ = _corpus()
    want = []
    for d, t, lang, source, n in rows:
        clean = t if t is None else pii.redact(t, pii.spans(t))
        want.append((d, clean, lang, source, None if t is None else len(clean)))
    got = corpus_pipeline.redact_personal_data(spark, _docs(spark, folder), folder)
    assert _key(map(tuple, got.collect())) == _key(want)
    assert sum(a != b[1] for a, b in zip((t for _, t, *_ in want), rows)) == 1


def test_mixing_chooses_to_the_weights(spark, folder):
    rows, _ = _corpus()
    domains = {0: "web", 1: "books", 2: "code"}
    docs = [(d, (domains[int(s[3:]) % 3] if s else "", lang or "", s or ""), len(re.findall(r"[^ \t\n\r]+", t or ""))) for d, t, lang, s, _ in rows]
    want = brute(docs, WEIGHTS, sum(n for *_, n in docs) * 6 // 10, 2, 11)
    got = corpus_pipeline.mix_sources(spark, _docs(spark, folder), folder)
    assert got.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _, _ in want)


def test_packing_places_every_piece(spark, folder):
    rows, _ = _corpus()
    word, ends, pieces = _tokenizer("word_bpe_49k.json"), {}, []
    for d, t, *_ in rows:
        ids = [*word.encode(t or "", add_special_tokens=False).ids, 1]
        pieces += [(d, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.pack_sequences(spark, _docs(spark, folder), folder).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(p[3] for p in pieces) // 4096)


def test_run_applies_all_stages(spark, folder):
    docs = _docs(spark, folder)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    strip = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    whole = strip(corpus_pipeline.run(spark, folder))
    assert whole == strip(docs) and not {r[0] for r in whole} & (_corpus()[1].keys() | {200, 201, 202})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, folder, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], _docs(spark, folder).where("doc_id < 40 or doc_id > 300").where("doc_id <> 304")
    assert stage(spark, docs.where("false"), folder).count() == 0
    wide = docs
    for c in CLASH:
        wide = wide.withColumn(c, F.lit(c))
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA)
    for c in CLASH:
        nulls = nulls.withColumn(c, F.lit(None).cast("string"))
    got = stage(spark, wide.union(nulls), folder)
    if name == "packing":
        assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} | {None}
    else:
        assert got.columns == wide.columns
        rows = got.collect()
        assert all(r[c] in (c, None) for r in rows for c in CLASH) and any(r.doc_id is not None for r in rows)
        plain = stage(spark, docs.union(nulls.select(*docs.columns)), folder)
        assert _key(tuple(r)[:5] for r in rows) == _key(map(tuple, plain.collect()))


def test_written_tables_can_be_removed(spark):
    table = storage.staged(spark.range(3), "t")
    path = table.inputFiles()[0]
    assert table.count() == 3
    storage.discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    other = storage.staged(spark.range(3), "t").inputFiles()[0]
    storage.clean(spark)
    with pytest.raises(Exception):
        spark.read.parquet(other).count()


def test_rules_beyond_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(12)
    label = lambda: str(rng.choice(["a", "b", "com", "org", "x-y"]))
    host = lambda: ".".join(label() for _ in range(int(rng.integers(1, 4))))
    path = lambda: "".join("/" + label() for _ in range(int(rng.integers(0, 4)))) + str(rng.choice(["", "/", "/b"]))
    rules = [urls.Rule(str(rng.choice(["allow", "block"])), host() + path()) for _ in range(60)]
    texts = [f"http://{host().upper()}{path()}?q#f" for _ in range(300)] + [None, "", "no url", "http://", "x://com/en"]
    pages = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts * 2)], "page_id long, url string, _row string, text string")
    want = urls.filter_urls(pages, rules)
    assert want.where("rule is not null").count() > 50
    monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", 10)
    for table in (rules, spark.createDataFrame([(r.verdict, r.text) for r in rules], "verdict string, rule string")):
        assert _key(map(tuple, urls.filter_urls(pages, table).select(*want.columns).collect())) == _key(map(tuple, want.collect()))
    assert urls.filter_urls(pages.where("false"), rules).count() == 0


def test_near_duplicates_of_long_texts(spark):
    long = " ".join(f"w{k % 9973}x{k % 17}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (2, long + " end"), (3, "other " + long[: len(long) // 2])], "doc_id long, text string").withColumn("key", F.lit("clash"))
    assert sorted((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()) == [(1, 1), (2, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id for r in neardup.without_near_duplicates(docs).collect()) == [1, 3]
