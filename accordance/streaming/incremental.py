"""Incremental runs: new report files are cleaned, new records flattened, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.functions.text import normalize_clean
from accordance.operators.cleaning import clean_texts
from accordance.operators.records import annotations


def new_files(spark: SparkSession, folder: str, pattern: str, per_batch: int = 1000) -> DataFrame:
    """A stream of file_name and raw, whole files."""
    stream = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).text(folder, wholetext=True)
    return stream.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))


def _run(stream: DataFrame, each, checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _once(table: DataFrame, folder: str, batch: int) -> None:
    """A batch that is run again replaces its own rows."""
    table.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def clean_new(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Cleans the text files that came since the last run."""

    def each(batch: DataFrame, number: int) -> None:
        docs = batch.select("file_name", F.col("raw").alias("text"))
        clean = clean_texts(docs, key="file_name")
        _once(clean.withColumn("text", normalize_clean(F.col("text"))), out, number)

    _run(new_files(spark, folder, "*.txt"), each, checkpoint)


def flatten_new(spark: SparkSession, folder: str, out: str, dead: str, checkpoint: str) -> None:
    """Flattens the records that came since the last run; unreadable ones go to ``dead``, to be mended and dropped in again."""

    def each(batch: DataFrame, number: int) -> None:
        good, bad = annotations(batch, ["file_name"])
        _once(good, out, number)
        _once(bad, dead, number)

    _run(new_files(spark, folder, "*.json"), each, checkpoint)


def latest_scores(stream: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """A stream of scores (at, model, score) as the mean of each model and window; rows later than ``delay`` are dropped."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", window).alias("span"), "model").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
