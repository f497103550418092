"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all documents that the one before kept; run() writes every
stage's rows as Parquet in the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accordance.llm import neardup, packing, pii, toxicity
from accordance.llm.queries import mixed
from accordance.llm.storage import discard, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5, by a model trained on the labels that aren't held out."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(docs, model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.without_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text where the table has it."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", _length(docs)) if "n_chars" in docs.columns else clean


def _length(docs: DataFrame):
    from pyspark.sql import functions as F

    return F.length("text").cast(docs.schema["n_chars"].dataType)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights, once for each epoch they are chosen in."""
    return mixed(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no trained model, signatures or tokenizers; tests hold each stage and run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
