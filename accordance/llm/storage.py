"""The shared folder of a run, and tables written there to cut a plan in two."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions that name none, by application.
_own: dict[str, str] = {}
#: Where the tables lie that may be discarded, by the identity of their frames.
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    A local session that sets no such folder gets a temporary one of its own; on a cluster the
    setting is required, since a machine's own folder can't be seen from another machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="accordance-")
        base = _own[context.applicationId]
    return f"{base.rstrip('/')}/accordance-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Removes the files of a table that ``staged`` gave, once nothing reads it any more."""
    path = _paths.pop(id(table), None)
    if path:
        _remove(table.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Removes all that this application's operators wrote in the shared folder; their lazy results can't be read after that."""
    _remove(spark, shared_dir(spark).rpartition("/")[0])


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    What follows doesn't recompute ``df``, also if an executor is lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = path
    weakref.finalize(table, _paths.pop, id(table), None)
    return table
