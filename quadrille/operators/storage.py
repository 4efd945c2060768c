"""Staged tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (local tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", found)
        _staged.append((spark, found))
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/quadrille-{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def drop_staged() -> None:
    """Deletes what staged() and new_path() have left, as far as the session still lives."""
    while _staged:
        spark, path = _staged.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001, S110  the session has ended, and its shared folder is the cluster's to clean
            pass


def reused(make: Callable[[], DataFrame], spark: SparkSession, path: str, key: str) -> DataFrame:
    """The table at `path` if it was written whole under the same key, else make() written there. The key goes last, so that a broken write counts as none."""
    note = f"{path}.key"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(note)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or [r.value for r in spark.read.text(note).collect()] != [key]:
        if fs.exists(where):
            fs.delete(where, True)
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        spark.createDataFrame([(key,)], "value STRING").coalesce(1).write.text(note)
    return spark.read.parquet(path)
