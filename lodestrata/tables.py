"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; it goes when the driver ends. Only a local master may leave that setting
    unset (as in tests): a temporary folder is then made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="lodestrata-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = "file://" + _local[0]
    if not _made:
        atexit.register(_drop_all)
    _made.append((spark, f"{base.rstrip('/')}/lodestrata/{uuid.uuid4().hex}"))
    return _made[-1][1]


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table, read again: computed once, and what follows survives lost executors."""
    path = path or work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop_folder(spark, path)
        except Exception:  # the JVM may have ended before the driver's Python
            return
