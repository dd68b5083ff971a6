"""Where queries register, with their SQL if SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def busy_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work on each row (tokens of texts): dealt out anew only if its files' splits would leave half of the
    cores idle."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > cores else df.repartition(cores)
