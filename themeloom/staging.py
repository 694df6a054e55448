"""Intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``.

A staged table cuts lineage like a checkpoint does and survives the loss of any executor. It is
Parquet, so later reads prune columns and Spark knows its size when it picks a join strategy.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Staged tables hold texts and tokens; this takes much less room than Parquet's default.
COMPRESSION = "zstd"

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}
#: Paths of the tables staged in this thread since ``stage_only`` began; nothing outside of it.
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def staging_root(spark: SparkSession) -> str:
    """Folder for this application's staged tables."""
    app_id = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return f"{shared.rstrip('/')}/themeloom/{app_id}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app_id not in _local_folders:
        _local_folders[app_id] = tempfile.TemporaryDirectory(prefix="themeloom-")
    return _local_folders[app_id].name


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the staging root."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    if (tables := _on_the_way.get()) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_only(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``build`` returns and delete the tables that it staged on the way.

    Nothing but the returned DataFrame may read what ``build`` stages. Other threads' tables stay.
    """
    outside = _on_the_way.get()
    tables: list[str] = []
    begun = _on_the_way.set(tables)
    try:
        result = stage(build(), name)
    finally:
        _on_the_way.reset(begun)
    *earlier, kept = tables
    for path in earlier:
        _delete(result.sparkSession, path)
    if outside is not None:
        outside.append(kept)
    return result


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables, once no DataFrame that reads them is needed."""
    _delete(spark, staging_root(spark))
