"""Sinks that write: tables kept by key as Parquet, a partition a bucket of keys.

A write reads only the buckets that its rows fall into and replaces only those in which something changes, so a second run of
the same write replaces nothing. What a bucket becomes is written beside the table first and then put in place by a dynamic
partition overwrite: a write that fails or is killed before that leaves the table as it was; one that is killed while
partitions are put in place may leave some old and some new, each whole, and is put right by running it again. One writer at a
time. Null is a key like any other; of several rows of a key in one write the largest counts; no rows change nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..tables import drop_folder, work_folder, written


@dataclass(frozen=True)
class Table:
    """A table's folder, schema (DDL), keys and number of buckets: enough that one is a few hundred MB, as a task writes it;
    the number is part of the table and must stay."""

    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    @property
    def names(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).alias("bucket")

    def typed(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """The named columns of rows as the table has them: hashes differ by type."""
        kinds = {f.name: f.dataType for f in StructType.fromDDL(self.schema)}
        return rows.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names)).select("*", self.bucket())


def create(spark: SparkSession, table: Table) -> None:
    """An empty table, unless there is one."""
    stored = StructType([*StructType.fromDDL(table.schema), StructField("bucket", LongType())])
    spark.createDataFrame([], stored).write.mode("ignore").partitionBy("bucket").parquet(table.path)


def _stored(spark: SparkSession, table: Table) -> DataFrame:
    return spark.read.schema(StructType([*StructType.fromDDL(table.schema), StructField("bucket", LongType())])).parquet(table.path)


def read(spark: SparkSession, table: Table) -> DataFrame:
    return _stored(spark, table).select(*table.names)


def upsert(spark: SparkSession, table: Table, rows: DataFrame) -> dict[str, int]:
    """Puts rows in place of those of their keys; how many were inserted, updated and unchanged, and buckets written."""
    rest = [n for n in table.names if n not in table.keys]
    new = table.typed(rows, table.names).groupBy("bucket", *table.keys).agg(F.max(F.struct(*rest) if rest else F.lit(True)).alias("new"))
    return _merged(spark, table, written(new), rest)


def delete(spark: SparkSession, table: Table, gone: DataFrame) -> dict[str, int]:
    """Takes the rows out whose keys are in gone; how many were deleted, and buckets written."""
    rest = [n for n in table.names if n not in table.keys]
    return _merged(spark, table, written(table.typed(gone, list(table.keys)).distinct()), rest, True)


def _merged(spark: SparkSession, table: Table, new: DataFrame, rest: list[str], gone: bool = False) -> dict[str, int]:
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most table.buckets rows, as below
    if not touched:
        return {"buckets": 0}
    value = F.struct(*rest) if rest else F.lit(True)
    old = _stored(spark, table).filter(F.col("bucket").isin(touched)).select("bucket", *table.keys, value.alias("old"), F.lit(True).alias("was"))
    new = new.withColumn("given", F.lit(True))
    # Both sides bear the same names; the keys of either may be null.
    pair = F.col("o.bucket") == F.col("n.bucket")
    for k in table.keys:
        pair &= F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    both = old.alias("o").join(new.alias("n"), pair, "full_outer")
    was, given = F.col("o.was").isNotNull(), F.col("n.given").isNotNull()
    same = F.lit(False) if gone else F.col("o.old").eqNullSafe(F.col("n.new"))
    status = F.when(~given, "kept").when(F.lit(gone), F.when(was, "deleted").otherwise("absent")).when(~was, "inserted").when(same, "unchanged").otherwise("updated")
    pick = lambda n: F.when(given, F.col(f"n.{n}")).otherwise(F.col(f"o.{n}")).alias(n)
    became = F.col("o.old") if gone else F.when(given, F.col("n.new")).otherwise(F.col("o.old"))
    folder = work_folder(spark)
    both.select(pick("bucket"), *(pick(k) for k in table.keys), became.alias("row"), status.alias("status")).write.parquet(folder)
    both = spark.read.parquet(folder)
    told = both.groupBy("bucket").pivot("status", ["kept", "unchanged", "inserted", "updated", "deleted"]).count().na.fill(0).collect()
    changed = {r.bucket: r for r in told if r.inserted + r.updated + r.deleted}
    counts = {n: sum(r[n] for r in told) for n in (["deleted"] if gone else ["inserted", "updated", "unchanged"])} | {"buckets": len(changed)}
    left = [b for b, r in changed.items() if r.kept + r.unchanged + r.inserted + r.updated]
    if left:
        rows = both.filter(F.col("bucket").isin(left) & ~F.col("status").isin("deleted", "absent"))
        rows = rows.select("*", "row.*") if rest else rows
        rows = rows.repartition(len(left), "bucket").select(*table.names, "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table.path)
    for b in set(changed) - set(left):  # an overwrite leaves partitions alone of which it has no row
        drop_folder(spark, f"{table.path}/bucket={b}")
    drop_folder(spark, folder)
    return counts
