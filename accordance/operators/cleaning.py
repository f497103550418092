"""Line-wise cleaning of report texts, as windows over a table of lines.

A table of lines has the document's key, pos (an array of numbers that orders lines) and line. Documents
are dealt by their key once; windows by key and line, and the joining of lines, stay in that partitioning.
Rows that share a key are one document each only if ``key`` tells them apart; null texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.functions import text as T


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line of each text."""
    dealt = docs.select(key, F.col(text).alias("_text")).repartition(key)
    lines = dealt.select(key, F.posexplode(F.split("_text", "\n")).alias("_pos", "line"))
    return lines.select(key, F.array("_pos").alias("pos"), "line")


def split_tables(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with bars become a line for each cell that isn't blank; other lines stay as they are."""
    cells = F.filter(F.transform(F.split("line", r"\|"), T.strip), lambda c: c != "")
    parts = F.when(F.col("line").contains("|"), cells).otherwise(F.array("line"))
    apart = lines.select(key, "pos", F.posexplode(parts).alias("_sub", "line"))
    return apart.select(key, F.concat("pos", F.array("_sub")).alias("pos"), "line")


def drop_repeated_blocks(lines: DataFrame, min_repeats: int = 5, longer_than: int = 30, key: str = "doc_id") -> DataFrame:
    """All copies of long lines that a document repeats go: page headers and footers. Lines are counted as they are written."""
    times = F.count("*").over(Window.partitionBy(key, "line"))
    long = F.length(T.strip(F.col("line"))) > longer_than
    return lines.withColumn("_n", times).where(~(long & (F.col("_n") >= min_repeats))).drop("_n")


def _first_of_line(key: str) -> Column:
    return F.row_number().over(Window.partitionBy(key, "line").orderBy("pos")) == 1


def dedup_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of equal lines, stripped; blank ones go."""
    bare = lines.withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    return bare.withColumn("_first", _first_of_line(key)).where("_first").drop("_first")


def dedup_metadata(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """As dedup_lines, but only of metadata lines; measurements and numbers may repeat."""
    bare = lines.withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    return bare.withColumn("_first", _first_of_line(key)).where(F.col("_first") | ~T.should_deduplicate(F.col("line"))).drop("_first")


def join_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text of documents that have lines."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def clean_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeats: int = 5) -> DataFrame:
    """key and text of every document: tables split, repeated blocks dropped, metadata lines once, white space normal.

    Documents whose lines all go, and null texts, have an empty text.
    """
    lines = dedup_metadata(drop_repeated_blocks(split_tables(split_lines(docs, key, text), key), min_repeats, key=key), key)
    clean = join_lines(lines, key).select(F.col(key).alias("_key"), T.normalize_clean(F.col("text")).alias("_clean"))
    everyone = docs.select(key).distinct()
    return everyone.join(clean, everyone[key].eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("_clean", F.lit("")).alias("text"))


def dedup_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the first of equal lines of each text, by array functions alone: no shuffle."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda c: c != "")
    return docs.withColumn(text, F.array_join(F.array_distinct(lines), "\n"))
