"""Files by name as a data source with a commit: all files of a job appear, or none does.

``df.write.format("named_files").mode("append").save(folder)`` writes the rows of name and value (text or bytes) each to the
file ``folder/name``. Tasks write below a hidden folder of the job, each attempt in one of its own; the commit moves the files
of the attempts that succeeded to their names, an abort removes them, and either removes the hidden folder, so what a lost
executor left goes too. ``mode("overwrite")`` also removes the folder's other files, once all new ones are there. Any store
that Arrow knows will do.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def store_of(path: str):
    """The Arrow file system of a path and the path in it; a path without a scheme is a local one."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.job = f"_job-{uuid.uuid4().hex}"
        store, at = store_of(self.folder)
        store.create_dir(f"{at}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, at = store_of(self.folder)
        own = f"{self.job}/{uuid.uuid4().hex}"
        store.create_dir(f"{at}/{own}", recursive=False)  # a task that goes on after the abort ends here
        names = []
        for row in iterator:
            name, value = row["name"], row["value"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"no name for a file: {name!r}")
            with store.open_output_stream(f"{at}/{own}/{name}") as out:
                out.write(value.encode() if isinstance(value, str) else bytes(value or b""))
            names.append(name)
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = store_of(self.folder)
        made = [m for m in messages if m is not None]
        names = [n for m in made for n in m.names]
        twice = sorted(n for n, k in Counter(names).items() if k > 1)
        if twice:
            self.abort(messages)
            raise ValueError(f"several rows for one file: {twice[:5]}")
        store.create_dir(at, recursive=True)
        before = {f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))} if self.overwrite else set()
        for m in made:
            for name in m.names:
                store.move(f"{at}/{m.folder}/{name}", f"{at}/{name}")
        for name in before.difference(names):
            store.delete_file(f"{at}/{name}")
        self._clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store_of(self.folder))

    def _clear(self, store, at: str) -> None:
        from pyarrow import fs

        for wait in (0.1, 0.5, 2.0, None):  # tasks that are being stopped may still write
            try:
                if store.get_file_info(f"{at}/{self.job}").type != fs.FileType.NotFound:
                    store.delete_dir(f"{at}/{self.job}")
                return
            except OSError:
                if wait is None:
                    raise
                time.sleep(wait)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if not {"name", "value"} <= {*schema.names}:
            raise ValueError("columns name and value")
        return NamedFilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)
