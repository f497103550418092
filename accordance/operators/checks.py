"""Range checks of records, and the bookkeeping of batch runs: what is done, what failed, and how fast.

A filter of finished keys is a table of 4 KB rows of bits (row, bits), so it is kept, grown by new keys and of a fixed size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from accordance.functions.values import as_number


class Range(NamedTuple):
    path: str
    low: float | None = None
    high: float | None = None
    open_ends: bool = False  # the ends themselves are out of range


# What is plausible in a report.
RANGES = (
    Range("patient.BMI", 10, 80, True),
    Range("patient.ESS", 0, 24),
    Range("soevn_opsummering.soevneffektivitet_procent", 0, 100),
    Range("soevn_opsummering.total_soevntid_tst_min", None, 700),
    Range("respirations_analyse.ahi_total", None, 150),
    Range("spo2_oversigt.minimum_procent.total", 50, None),
)


def range_warnings(leaves: DataFrame, keys: list[str], ranges: tuple[Range, ...] = RANGES, value: str = "raw") -> DataFrame:
    """keys, path, the value's text and its number, for each leaf out of range. What is no number never warns."""
    number = as_number(F.col(value))
    bad = F.lit(False)
    for r in ranges:
        out = F.lit(False)
        if r.low is not None:
            out = out | (number <= r.low if r.open_ends else number < r.low)
        if r.high is not None:
            out = out | (number >= r.high if r.open_ends else number > r.high)
        bad = bad | ((F.col("path") == r.path) & out)
    watched = leaves.where(F.col("path").isin(*(r.path for r in ranges)))
    return watched.where(bad).select(*keys, "path", F.col(value).alias("value"), number.alias("number"))


def not_done(inputs: DataFrame, outputs: DataFrame, key: str, n: int | None = None, limit_first: bool = False) -> DataFrame:
    """The inputs without an output. ``n``: at most so many by key, counted after the done ones go, or before."""
    take = lambda df: df if n is None else df.orderBy(key).limit(n)
    done = outputs.select(key).distinct()
    return take(inputs).join(done, key, "left_anti") if limit_first else take(inputs.join(done, key, "left_anti"))


def status_counts(log: DataFrame, by: tuple[str, ...] = (), status: str = "status") -> DataFrame:
    """by, n_ok, n_error and n_skipped."""
    return log.groupBy(*by).agg(*(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in ("ok", "error", "skipped")))


def throughput(log: DataFrame, tokens: str = "tokens", seconds: str = "seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """by, all tokens, all seconds, and tokens a second as the ratio of the sums."""
    sums = log.groupBy(*by).agg(F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"))
    return sums.withColumn("tokens_a_second", F.try_divide("tokens", "seconds"))


#: Bits of a filter of finished keys (16 MB), and how many each key sets.
FILTER_BITS, HASHES = 1 << 27, 3


def _places(key: Column, bits: int) -> list[Column]:
    """A key's places in the filter, from 1."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) + 1 for k in range(HASHES)]


def done_filter(outputs: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """row and bits of the filter of ``outputs``' keys."""
    at = outputs.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def grown_filter(before: DataFrame, more: DataFrame) -> DataFrame:
    """The filter of the keys of both, of one size; only the filters are read."""
    return before.unionByName(more).groupBy("row").agg(F.bitmap_or_agg("bits").alias("bits"))


def not_done_by_filter(inputs: DataFrame, outputs: DataFrame, key: str, done: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """As not_done, the outputs' filter (``done``, of FILTER_BITS bits or as given) being at hand: inputs that it doesn't
    have go straight through, and only the others, which may be done, are shuffled and joined with the outputs.

    The filter is broadcast; its size is that of ``bits``, whatever the keys. It must have every output's key.
    """
    names = [f"_p{k}" for k in range(HASHES)]
    rows = inputs.select(F.struct(*(F.col(f"`{c}`") for c in inputs.columns)).alias("_in"), *(p.alias(n) for p, n in zip(_places(F.col(f"`{key}`"), bits), names)))
    for k, name in enumerate(names):
        side = F.broadcast(done.select(F.col("row").alias(f"_r{k}"), F.col("bits").alias(f"_b{k}")))
        rows = rows.join(side, F.bitmap_bucket_number(name) == F.col(f"_r{k}"), "left")
    has = F.lit(True)
    for k, name in enumerate(names):
        at = F.bitmap_bit_position(name)
        byte = F.conv(F.hex(F.substring(F.col(f"_b{k}"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        has = has & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    rows = rows.select("_in", has.alias("_has"))
    maybe = rows.where("_has").select("_in.*").join(outputs.select(key).distinct(), key, "left_anti").select(*(F.col(f"`{c}`") for c in inputs.columns))
    return rows.where("not _has").select("_in.*").unionByName(maybe)


def write_batch(rows: DataFrame, folder: str, status: str = "status", tokens: str = "tokens", seconds: str = "seconds") -> dict:
    """Writes a batch's rows, the good ones and the dead letters, to a folder of each status, and counts them in the same pass.

    One job: the rows are computed once, and the counts (n_ok, n_error, n_skipped, tokens, seconds, tokens_a_second, as
    status_counts and throughput have them) are observed while they are written. Rows of a null status are an error.
    """
    known = rows.withColumn(status, F.coalesce(status, F.lit("error")))
    seen = Observation()
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s}") for s in ("ok", "error", "skipped")]
    known.observe(seen, *counts, F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds")).write.partitionBy(status).mode("append").parquet(folder)
    found = dict(seen.get)
    return found | {"tokens_a_second": found["tokens"] / found["seconds"] if found["seconds"] else None}
