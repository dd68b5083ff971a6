"""Gives Python workers this package where their path does not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to all executors through Spark's file server, once an application."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _sent or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), "lodestrata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
