"""Scans of path lists, texts and JSON files, and the sinks beside them. All through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from accordance.functions.text import strip
from accordance.operators.match import trial_number
from accordance.sources.named import register


def path_list(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """path and pos: the part before the first semicolon of every line that isn't blank, in order; the first ``n``."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    paths = text.select("pos", strip(F.split_part("line", F.lit(";"), F.lit(1))).alias("path")).where("path <> ''")
    return paths if n is None else paths.orderBy("pos").limit(n)


#: Tasks a core of a scan of many small files; Spark makes one of every few files, whose start takes longer than their reading.
TASKS_A_CORE = 32


def _fewer_tasks(found: DataFrame) -> DataFrame:
    return found.coalesce(TASKS_A_CORE * found.sparkSession.sparkContext.defaultParallelism)


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = False, **options) -> DataFrame:
    """file_name, file_path and text of each file.

    Files whose ending says that they aren't compressed are read as bytes: for many small ones Spark's reader of whole texts, which
    asks for each file by what it is compressed, takes several times as long.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).options(**options)
    plain = pattern.endswith((".txt", ".json"))
    found = reader.format("binaryFile").load(folder) if plain else reader.text(folder, wholetext=True)
    return _fewer_tasks(found.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.col("content" if plain else "value").cast("string").alias("text")))


def json_records(spark: SparkSession, folder: str, source: str, recursive: bool = False) -> DataFrame:
    """source, file_name, file_path and raw (the JSON text) of each JSON file."""
    return texts(spark, folder, "*.json", recursive).select(F.lit(source).alias("source"), "file_name", "file_path", F.col("text").alias("raw"))


def trial_records(spark: SparkSession, folders: list[str]) -> DataFrame:
    """source (the folder's place), trial, file_name and raw of files called output-trialN.json."""
    out = None
    for k, folder in enumerate(folders):
        part = json_records(spark, folder, str(k)).withColumn("trial", trial_number()).where("trial is not null")
        out = part if out is None else out.union(part)
    return out


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, file_path and content of Word files, for sources.docx."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    return _fewer_tasks(found.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file_name"), F.col("path").alias("file_path"), "content"))


def listed(found: DataFrame, paths: DataFrame) -> DataFrame:
    """The files of ``found`` that a path list names, with or without their store; named files that don't exist are silently left out.

    ``file:///a``, ``hdfs://host:8020/a`` and ``/a`` are one path, if the list names no store; percent codes are read.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), "^/+", "/")
    whole = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    path = F.try_url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    named = paths.select(F.col("path").alias("_p")).distinct().select(F.when(F.col("_p").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), whole(F.col("_p"))).otherwise(bare(F.col("_p"))).alias("_p"))
    keyed = found.withColumn("_names", F.array(whole(path), bare(path)))
    met = keyed.select("file_path", F.explode("_names").alias("_p")).join(named, "_p", "left_semi").select("file_path").distinct()
    return keyed.drop("_names").join(met, "file_path", "left_semi").select(*found.columns)


def wrapped(name: Column, body: Column) -> Column:
    """A report text between its first and last mark."""
    return F.concat(F.lit("=== PSG RAPPORT ===\nFilnavn: "), name, F.lit("\n\n"), body, F.lit("\n\n=== SLUT ==="))


def write_texts(df: DataFrame, folder: str, name: str = "file_name", text: str = "text", order: str | None = None, suffix: str = ".txt") -> int:
    """A UTF-8 file stem.txt in ``folder`` for each different stem of the names; returns how many.

    Of rows with one stem the last in ``order`` stays, the largest text without it, as if written one after another. Tasks
    write, to any store that Arrow knows; all files appear at the end or, if the job fails, none. Null names are left out,
    null texts are empty.
    """
    spark = df.sparkSession
    register(spark)
    stem = F.concat(F.regexp_replace(F.col(name), r"(?<=.)\.[^.]*$", ""), F.lit(suffix))
    last = F.max_by(text, order) if order else F.max(text)
    once = df.where(F.col(name).isNotNull()).groupBy(stem.alias("name")).agg(F.coalesce(last, F.lit("")).alias("value"))
    seen = Observation()
    once.observe(seen, F.count("*").alias("n")).write.format("named_files").mode("append").save(folder)
    return seen.get["n"]


def write_json(df: DataFrame, folder: str, name: str = "file_name", raw: str = "raw", order: str | None = None) -> int:
    """As write_texts, the JSON texts as stem.json; never over their own input."""
    return write_texts(df, folder, name, raw, order, ".json")


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of a report as Parquet, and as lines of JSON with nulls."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        table.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}.json")


def read_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def log_errors(dead: DataFrame, path: str) -> None:
    """Appends dead letters with the time they were logged."""
    dead.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
