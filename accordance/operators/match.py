"""Pairing files of two sources by name or number, and aligning trials over several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.functions.text import first_number


def _one_a_number(names: DataFrame) -> DataFrame:
    """number and name, the last name in order for each number."""
    numbered = names.select("name", first_number(F.col("name")).alias("number")).where("number is not null")
    return numbered.groupBy("number").agg(F.max("name").alias("name"))


def match_files(left: DataFrame, right: DataFrame, name: str = "file_name") -> DataFrame:
    """left_file, right_file, match_kind (exact, number, or unpaired) and pair_ord of every file of both sides.

    Equal names pair first. Of the rest, files with the same first number in their names pair, one a side
    for each number, the last in order. Unpaired files have null on the other side and no pair_ord. pair_ord
    sorts exact pairs by name before number pairs by number; it is a struct, so nothing is numbered in one task.
    Repeated and null names count once and not at all.
    """
    mine, theirs = (side.select(F.col(name).alias("name")).where("name is not null").distinct() for side in (left, right))
    exact = mine.join(theirs, "name")
    rest_left, rest_right = mine.join(theirs, "name", "left_anti"), theirs.join(mine, "name", "left_anti")
    by_number = _one_a_number(rest_left).withColumnRenamed("name", "left_file").join(_one_a_number(rest_right).withColumnRenamed("name", "right_file"), "number")
    lone_left = rest_left.join(by_number.select(F.col("left_file").alias("name")), "name", "left_anti")
    lone_right = rest_right.join(by_number.select(F.col("right_file").alias("name")), "name", "left_anti")
    order = lambda kind, number, name: F.struct(F.lit(kind).alias("kind"), number.cast("bigint").alias("number"), name.alias("name"))
    nothing = F.lit(None).cast("string")
    no_order = F.lit(None).cast("struct<kind:int,number:bigint,name:string>")
    return (
        exact.select(F.col("name").alias("left_file"), F.col("name").alias("right_file"), F.lit("exact").alias("match_kind"), order(0, F.lit(None), F.col("name")).alias("pair_ord"))
        .union(by_number.select("left_file", "right_file", F.lit("number"), order(1, F.col("number"), F.col("left_file"))))
        .union(lone_left.select("name", nothing, F.lit("unpaired"), no_order))
        .union(lone_right.select(nothing, "name", F.lit("unpaired"), no_order))
    )


def align_trials(files: DataFrame, n_folders: int, trial: str = "trial", folder: str = "folder") -> DataFrame:
    """trial, n_present and complete, for every trial of any folder."""
    return files.groupBy(trial).agg(F.count_distinct(folder).alias("n_present")).withColumn("complete", F.col("n_present") == n_folders)


def missing_trials(files: DataFrame, folders: list, trial: str = "trial", folder: str = "folder") -> DataFrame:
    """trial and folder of every trial that a folder lacks. ``folders``: all there are, a few."""
    have = files.groupBy(trial).agg(F.collect_set(folder).alias("_have"))
    lacks = F.array_except(F.array(*(F.lit(f) for f in folders)), "_have")
    return have.select(trial, F.explode(lacks).alias(folder))


def complete_trials(files: DataFrame, n_folders: int, trial: str = "trial", folder: str = "folder") -> DataFrame:
    """The files of trials that all folders have."""
    return files.join(align_trials(files, n_folders, trial, folder).where("complete").select(trial), trial, "left_semi")


def trial_number(name: str = "file_name") -> Column:
    """The number of a file called output-trialN.json; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^output-trial([0-9]+)", 1), F.lit("")).try_cast("bigint")


def in_name_order(files: DataFrame, n: int, name: str = "file_name") -> DataFrame:
    """The first ``n`` files by name."""
    return files.orderBy(name).limit(n)


def last_of(files: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each ``by`` in ``order``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return files.withColumn("_k", place).where("_k = 1").drop("_k")
