"""Word files as a data source: ``spark.read.format("word").load(folder)``.

Columns are file_name, file_path, body (the lines of the file, or all its text with the option ``fast``) and error; a broken
file is a row with its error. With a schema of fewer columns only those are made, and files aren't opened if body and error
aren't among them. Files are dealt to partitions by size (option ``partition_bytes``), small ones many together. Options
``pattern`` (a glob of names) and ``recursive``. Any store that Arrow knows will do.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from accordance.sources import docx
from accordance.sources.named import store_of

COLUMNS = ("file_name", "file_path", "body", "error")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


@dataclass
class Files(InputPartition):
    paths: list[str]


def dealt(sizes: list[tuple[str, int]], most: int, each: int = 4096) -> list[list[str]]:
    """Paths in groups of at most ``most`` bytes, an empty file counting ``each``; a larger one is a group. The largest first,
    each to the first group with room among the last few."""
    groups: list[tuple[int, list[str]]] = []
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        size += each
        for k in range(max(0, len(groups) - 8), len(groups)):
            if groups[k][0] + size <= most:
                groups[k] = groups[k][0] + size, [*groups[k][1], path]
                break
        else:
            groups.append((size, [path]))
    return [paths for _, paths in groups]


class WordReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.names
        self.folder = options["path"]
        self.fast = options.get("fast", "false").lower() == "true"
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.pattern = options.get("pattern", "*.docx")
        self.bytes = int(options.get("partition_bytes", 32 << 20))
        unknown = {*self.columns}.difference(COLUMNS)
        if unknown:
            raise ValueError(f"no columns of Word files: {sorted(unknown)}")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, at = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(at, recursive=self.recursive))
        own = [(f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith((".", "_", "~"))]
        return [Files(paths) for paths in dealt(own, self.bytes)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        opened = bool({"body", "error"} & {*self.columns})
        for path in partition.paths:
            row = {"file_name": path.rsplit("/", 1)[-1], "file_path": path, "body": None, "error": None}
            if opened:
                try:
                    with store.open_input_stream(path) as f:
                        content = f.read()
                    row["body"] = docx.all_text(content) if self.fast else "\n".join(docx.lines(content))
                except Exception as e:  # a broken file is a row with its error
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
            yield tuple(row[c] for c in self.columns)


class WordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "word"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WordReader:
        return WordReader(schema, dict(self.options))


def scan(spark: SparkSession, folder: str, fast: bool = False, **options) -> DataFrame:
    """file_name, text and error of a folder's Word files, as docx.read_docx gives them."""
    spark.dataSource.register(WordFiles)
    found = spark.read.format("word").schema("file_name string, body string, error string").options(fast=fast, **options).load(folder)
    return docx.reports(found, fast).select("file_name", F.col("text"), "error")
