"""Tables written once in the folder that driver and executors share, so that what follows doesn't compute them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new name under ``spark.checkpoint.dir``; a local session that sets none has a temporary folder, a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="accordance-")
        base = _own[context.applicationId]
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet and read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes all that ``stored`` wrote for this application; tables that read it can't be read after that."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark).rpartition("/")[0])
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
