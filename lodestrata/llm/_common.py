"""What the operators of this subpackage share: intermediate tables and Arrow batches of texts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


_local: list[str] = []
#: Work folders that are still there, in the order in which they were made.
_made: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share. The tables in it back the frames that
    operators return; it goes with drop_made, or when the driver ends.

    Only a local master may leave that setting unset (as in tests); a temporary folder is then made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="lodestrata-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = "file://" + _local[0]
    if not _made:
        atexit.register(_drop_rest, spark)
    _made.append(f"{base.rstrip('/')}/lodestrata/{uuid.uuid4().hex}")
    return _made[-1]


def folders_made() -> int:
    return len(_made)


def drop_made(spark: SparkSession, since: int) -> None:
    """Deletes the work folders made since folders_made() gave that number; no frame that reads them may be used later."""
    while len(_made) > since:
        drop_folder(spark, _made.pop())


def _drop_rest(spark: SparkSession) -> None:
    try:
        drop_made(spark, 0)
    except Exception:  # the JVM may have ended before the driver's Python
        _made.clear()


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Writes df as a Parquet table and reads it again: this cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that no returned frame reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_name(wanted: str, taken: list[str]) -> str:
    """wanted, with underscores until no column of taken has the name (names compare without case)."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def map_texts(docs: DataFrame, start: Callable[[], Callable[[list], list]], fields: list[T.StructField], keep: list[str], text: str = "text", most: int = 8_000_000) -> DataFrame:
    """Adds columns that are computed from each whole text; map-only, in Arrow batches.

    start runs once in a task and returns a function from a batch's texts (None for null) to one tuple of
    new values a text. keep names the columns that pass through unchanged, before the new ones. Batches
    are cut to about most bytes each.
    """
    ship(docs.sparkSession)
    out = T.StructType([*(docs.schema[c] for c in keep), *fields])
    columns = [*dict.fromkeys([*keep, text])]
    extra = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in batches:
            for part in small(b, most):
                values = work(part.column(columns.index(text)).to_pylist())
                new = [pa.array([v[i] for v in values], type=f.type) for i, f in enumerate(extra)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *new], names=[*keep, *extra.names])

    return docs.select(*columns).mapInArrow(run, out)


def small(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about most bytes each, so that a task's Python objects stay bounded."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
