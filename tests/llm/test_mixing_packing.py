"""Mixing and packing against plain Python."""

import hashlib
import itertools
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordance.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string"

WEIGHTS = [{"en": 3}, {"s0": 2, "*": 1}]


def _levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def _rows():
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 30))), ["en", "de", None][k % 3], f"s{k % 4}") for k in range(50)]
    return rows + [(50, None, "en", "s0"), (51, "", "fr", None), (7, "again and again", "de", "s3"), (52, "w " * 5000, "en", "s1")]


def _shared(budget, children):
    """Whole shares of (cap, weight, name) that add up to the budget: full children first, the rest by weight, what is over by name."""
    share, open_ = {}, sorted(children, key=lambda c: (Fraction(c[0], c[1]), c[2]))
    left = budget
    while open_ and open_[0][0] * sum(w for _, w, _ in open_) <= left * open_[0][1]:
        cap, _, name = open_.pop(0)
        share[name], left = cap, left - cap
    wide = sum(w for _, w, _ in open_)
    share |= {name: left * w // wide for _, w, name in open_}
    for name in sorted(n for _, _, n in open_)[: left - sum(share[n] for _, _, n in open_)]:
        share[name] += 1
    return share


def brute(docs, weights, budget, max_epochs, seed):
    """doc_id, tokens and epoch of what mix chooses of ``docs`` (doc_id, levels, tokens)."""
    leaves = Counter()
    for _, leaf, n in docs:
        leaves[leaf] += n

    def once(limits):
        """Of each leaf: what it gives, how many tokens, the tokens of what comes next, and its rest."""
        most = lambda leaf: min(max_epochs * leaves[leaf], limits.get(leaf, max_epochs * leaves[leaf]))

        def cap(above):
            return sum(most(leaf) for leaf in leaves if leaf[: len(above)] == above)

        def down(above, share):
            if len(above) < len(weights):
                names = sorted({leaf[len(above)] for leaf in leaves if leaf[: len(above)] == above})
                level = weights[len(above)]
                given = _shared(share, [(cap((*above, x)), level.get(x, level.get("*", 1)), x) for x in names])
                return {leaf: c for x in names for leaf, c in down((*above, x), given[x]).items()}
            total = leaves[above]
            whole, rest = divmod(share, total) if total else (0, 0)
            mine = [(d, n) for d, leaf, n in docs if leaf == above]
            chosen = [(d, n, e) for e in range(whole) for d, n in mine]
            place = lambda x: hashlib.md5(f"{seed}:{whole}:{x[0]}".encode()).hexdigest()
            done, next_ = 0, None
            for _, same in itertools.groupby(sorted(mine, key=place) if rest else [], key=place):
                same = list(same)
                if done + sum(n for _, n in same) > rest:
                    next_ = sum(n for _, n in same)
                    break
                done += sum(n for _, n in same)
                chosen += [(d, n, whole) for d, n in same]
            return {above: (chosen, whole * total + done, next_, rest - done)}

        return down((), min(budget, cap(())))

    first = once({})
    over = sum(rest for *_, rest in first.values())
    limits = {leaf: used for leaf, (_, used, next_, rest) in first.items() if rest and next_ is not None and next_ > over}
    return sorted(c for chosen, *_ in (once(limits) if limits else first).values() for c in chosen)


def _brute(rows, budget, max_epochs, seed):
    return brute([(d, (lang or "", source or ""), len((t or "").split())) for d, t, lang, source in rows], WEIGHTS, budget, max_epochs, seed)


def test_what_a_long_document_blocks_goes_to_siblings(spark):
    """One leaf can't begin its only document; its sibling gives what it would have, and the other family what it had."""
    rows = [(k, "w " * 10, "en", "s2") for k in range(50)] + [(100, "w " * 5000, "en", "s1")] + [(200 + k, "w " * 10, "de", "s3") for k in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, _levels(), [{}, {}], F.lit(400), max_epochs=1, seed=3)
    sums = {r.source: r.n for r in got.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    assert sums == {"s2": 200, "s3": 200}
    # a family that is blocked as a whole leaves its share to the other one
    got = mixing.mix(docs.where("source <> 's2'"), _levels(), [{}, {}], F.lit(400), max_epochs=1, seed=3)
    assert {r.source: r.n for r in got.groupBy("source").agg(F.sum("tokens").alias("n")).collect()} == {"s3": 400}


@pytest.mark.parametrize("budget,epochs", [(0, 1), (150, 1), (400, 2), (900, 2), (6000, 1), (10**6, 3)])
def test_mixing_against_plain_python(spark, budget, epochs):
    rows = _rows()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), _levels(), WEIGHTS, F.lit(budget), max_epochs=epochs, seed=5)
    assert sorted((r.doc_id, r.tokens, r.epoch) for r in got.collect()) == _brute(rows, budget, epochs, 5)


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    for name in ("rest", "whole", "last", "row", "_lang", "slice", "place", "_epochs", "n", "to"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    got = mixing.mix(docs.withColumn("tokens", F.lit("old")).withColumn("Epoch", F.lit("old")), _levels(), WEIGHTS, F.lit(400), seed=5)
    assert got.columns == [*docs.columns, "epoch", "tokens"]
    rows = got.collect()
    assert sorted((r.doc_id, r.tokens, r.epoch) for r in rows) == _brute(_rows(), 400, 2, 5)
    assert all(r.rest == f"rest{r.doc_id}" and r._lang == f"_lang{r.doc_id}" for r in rows)
    assert mixing.mix(docs.where("false"), _levels(), WEIGHTS, F.lit(400)).count() == 0


def _least(pieces, capacity):
    """The least number of sequences, by trying all."""
    pieces = sorted(pieces, reverse=True)
    best = [len(pieces)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(pieces):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= pieces[at]}:
            k = rooms.index(room)
            place(at + 1, [*rooms[:k], room - pieces[at], *rooms[k + 1 :]])
        place(at + 1, [*rooms, capacity - pieces[at]])

    if pieces:
        place(0, [])
    return best[0] if pieces else 0


def test_fixed_sets_never_cost_a_sequence():
    rng = np.random.default_rng(9)
    triples = 0
    for _ in range(400):
        sizes = rng.integers(int(rng.integers(1, 6)), 21, int(rng.integers(1, 9))).tolist()
        stock = packing._Stock(Counter(sizes))
        runs, bins = packing._reduce(stock, 20)
        left = [s for s, n in stock.left.items() for _ in range(n)]
        assert bins + _least(left, 20) == _least(sizes, 20), sizes
        assert Counter(left) + Counter({s: 0 for s in left}) + sum((Counter({r[0]: r[4]}) for r in runs), Counter()) == Counter(sizes)
        triples += any(n >= 3 for n in Counter(b for r in runs for b in range(r[2], r[2] + r[4])).values())
        assert packing.plan(Counter(sizes), 20)[1] <= _least(sizes, 20) + 1
    assert triples > 10


def test_packing_by_join_is_the_same(spark, monkeypatch):
    items = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (1 + F.pmod(F.xxhash64("id"), F.lit(60))).alias("length"))
    key = lambda df: sorted(map(tuple, df.collect()))
    one = key(packing.pack(items, 100))
    monkeypatch.setattr(packing, "MAX_RUNS", 3)
    monkeypatch.setattr(packing, "RANKS", 8)
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    other = packing.pack(items, 100)
    rows = other.collect()
    assert len(rows) == 3000 and {r.sequence_id for r in rows} == {r[3] for r in one}
    for table in (one, key(other)):
        ends = {}
        for _, _, length, sequence, offset in sorted(table, key=lambda r: (r[3], r[4])):
            assert offset == ends.get(sequence, 0)
            ends[sequence] = offset + length
        assert max(ends.values()) <= 100


def test_packing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("piece", F.lit(-1))
    rows = packing.pack_documents(docs, 8).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start) for r in rows) == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.pack_documents(docs.where("false")).count() == 0
