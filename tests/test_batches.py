"""States of alpha, filters of finished keys, counts while writing, and a model for each worker."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from accordance.operators import agreement, checks, generate
from accordance.sources import staging


def test_states_merge_in_any_order(spark, tmp_path):
    rows = [(None if k % 5 == 0 else f"t{k % 3}", k % 17, float(k * k % 11) + 1e6, f"v{k % 4}") for k in range(400)] + [("t0", 3, None, None), ("t1", 4, float("nan"), "v1")]
    ann = spark.createDataFrame(rows, "trial string, unit int, x double, v string").cache()
    batches = [ann.where(F.pmod(F.hash("unit", "x", "v"), F.lit(3)) == k) for k in range(3)]
    for state_of, alpha_of, whole, value in ((agreement.nominal_state, agreement.nominal_alpha, agreement.alpha_nominal, "v"), (agreement.interval_state, agreement.interval_alpha, agreement.alpha_interval, "x")):
        stored = []
        for k, batch in enumerate(batches):
            state_of(batch, "unit", value, ("trial",)).write.parquet(f"{tmp_path}/{value}{k}")
            stored.append(spark.read.parquet(f"{tmp_path}/{value}{k}"))
        want = {r.trial: (r.n_values, pytest.approx(r.alpha, abs=1e-9)) for r in whole(ann, "unit", value, ("trial",)).collect()}
        assert len(want) == 4
        for a, b, c in itertools.permutations(stored):
            state = agreement.merged_states([agreement.merged_states([a, b], "unit", ("trial",)), c], "unit", ("trial",))
            assert {r.trial: (r.n_values, r.alpha) for r in alpha_of(state, "unit", ("trial",)).collect()} == want


def test_filter_of_finished_keys(spark):
    inputs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.lit("k").alias("row"), F.lit(1).alias("a.b"))
    inputs = spark.createDataFrame([], "doc_id long, row string, `a.b` int").unionByName(inputs)
    inputs = inputs.unionByName(spark.createDataFrame([(None, "k", 1), (5, "k", 2)], inputs.schema))
    outputs = [spark.range(k, 3000, 7).select(F.col("id").alias("doc_id")) for k in range(3)]
    for bits in (1 << 10, 1 << 15, 1 << 20):  # also one so full that it has every key
        done, written = None, None
        for more in outputs:
            mine = checks.done_filter(more, "doc_id", bits)
            done = mine if done is None else checks.grown_filter(done, mine)
            written = more if written is None else written.union(more)
        found = checks.not_done_by_filter(inputs, written, "doc_id", done, bits)
        assert found.columns == inputs.columns
        assert sorted(map(repr, found.collect())) == sorted(map(repr, checks.not_done(inputs, written, "doc_id").collect()))
    none = checks.done_filter(outputs[0].where("false"), "doc_id")
    assert checks.not_done_by_filter(inputs, outputs[0].where("false"), "doc_id", none).count() == inputs.count()


def test_counts_while_writing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        calls.add(1)
        return x

    log = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 10 == 0, "error").when(F.col("id") % 10 == 1, "skipped").when(F.col("id") == 999, None).otherwise("ok").alias("status"), seen("id").alias("tokens"), F.lit(0.5).alias("seconds"))
    got = checks.write_batch(log, str(tmp_path / "b"))
    assert calls.value == 1000  # one pass
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == 1000 and back.where("status = 'error'").count() == 101
    want = checks.status_counts(back).first().asDict() | checks.throughput(back).first().asDict()
    assert got == want
    assert checks.write_batch(log.where("false"), str(tmp_path / "c")) == {"n_ok": 0, "n_error": 0, "n_skipped": 0, "tokens": None, "seconds": None, "tokens_a_second": None}


def test_a_model_for_each_worker(spark, tmp_path):
    built = str(tmp_path)

    def make():
        import uuid

        open(f"{built}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(prompts):
            assert [len(p) for p in prompts] == sorted(len(p) for p in prompts)  # of like length together
            if any(p == "bad" * 3 for p in prompts):
                raise ValueError("no")
            return [(p.upper(), len(p)) for p in prompts]

        return model

    rows = spark.range(0, 200, 1, 40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, "badbadbad").otherwise(F.expr("repeat('x', cast(1 + id * 37 % 50 as int))")).alias("prompt"))
    for _ in range(2):
        found = {r.doc_id: r for r in generate.generate(rows, make, batch=3).collect()}
        assert all(found[r.doc_id].response == r.prompt.upper() and found[r.doc_id].tokens == len(r.prompt) for r in rows.where("doc_id <> 77").collect())
        assert found[77].response is None and found[77].error == "ValueError: no" and found[77].attempts == 3
    names = os.listdir(built)
    assert len(names) == len({n.split("-")[0] for n in names}) <= 16  # 80 tasks, one model a process


def test_stored_tables_go(spark):
    table = staging.stored(spark.range(10))
    other = staging.shared_folder(spark)
    spark.range(3).write.parquet(other)
    assert table.count() == 10
    staging.clean(spark)
    with pytest.raises(Exception):
        spark.read.parquet(other).count()
