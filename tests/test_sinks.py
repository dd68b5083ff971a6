"""Tables kept by key on disk."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import sinks


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = sinks.Table(f"{tmp_path}/t", "path string, line int, text string", ("path", "line"), 8)
    sinks.create(spark, t)
    return t


def test_only_changed_buckets_are_written(spark, table):
    assert sinks.read(spark, table).count() == 0
    rows = spark.createDataFrame([(f"f{i}", i, "x") for i in range(100)], "path string, line long, text string")
    assert sinks.upsert(spark, table, rows) == {"inserted": 100, "updated": 0, "unchanged": 0, "buckets": 8}
    before = files(table.path)
    assert sinks.upsert(spark, table, rows.withColumn("bucket", F.lit("of another kind"))) == {"inserted": 0, "updated": 0, "unchanged": 100, "buckets": 0}
    assert files(table.path) == before
    sinks.create(spark, table)
    assert sinks.upsert(spark, table, rows.filter("line = 7").withColumn("text", F.lit("y"))) == {"inserted": 0, "updated": 1, "unchanged": 0, "buckets": 1}
    after = files(table.path)
    assert len(before.items() - after.items()) == 1 and len(after) == 8
    assert sorted((r.line, r.text) for r in sinks.read(spark, table).collect()) == [(i, "y" if i == 7 else "x") for i in range(100)]
    assert sinks.read(spark, table).dtypes == [("path", "string"), ("line", "int"), ("text", "string")]


def test_nulls_repeats_and_nothing(spark, table):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), ("p", None, None), ("p", None, None)], "path string, line int, text string")
    assert sinks.upsert(spark, table, rows)["inserted"] == 2
    assert sinks.upsert(spark, table, rows)["buckets"] == 0 and sinks.upsert(spark, table, rows.limit(0)) == {"buckets": 0}
    assert sorted(map(str, sinks.read(spark, table).collect())) == ["Row(path='p', line=None, text=None)", "Row(path=None, line=1, text='b')"]


def test_deletes(spark, table):
    rows = spark.range(50).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line"), F.lit("x").alias("text"))
    sinks.upsert(spark, table, rows)
    assert sinks.delete(spark, table, rows.filter("line < 10")) == {"deleted": 10, "buckets": len({r[0] for r in rows.filter("line < 10").select(table.bucket()).collect()})}
    assert sinks.delete(spark, table, rows.filter("line < 10"))["buckets"] == 0
    assert sorted(r.line for r in sinks.read(spark, table).collect()) == list(range(10, 50))
    sinks.delete(spark, table, rows)
    assert sinks.read(spark, table).count() == 0 and not files(f"{table.path}")
    assert sinks.upsert(spark, table, rows)["inserted"] == 50


def test_failed_write_leaves_the_table(spark, table):
    rows = spark.range(20).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line"), F.lit("x").alias("text"))
    sinks.upsert(spark, table, rows)
    before = files(table.path)
    broken = rows.withColumn("text", F.when(F.col("line") < 19, "y").otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        sinks.upsert(spark, table, broken)
    assert files(table.path) == before and sinks.read(spark, table).filter("text = 'x'").count() == 20


def test_keys_alone(spark, tmp_path):
    t = sinks.Table(f"{tmp_path}/k", "a long, b long", ("a", "b"), 4)
    sinks.create(spark, t)
    rows = spark.range(9).select(F.col("id").alias("a"), (F.col("id") % 2).alias("b"))
    assert sinks.upsert(spark, t, rows)["inserted"] == 9 and sinks.upsert(spark, t, rows)["buckets"] == 0
    assert sinks.delete(spark, t, rows.filter("b = 1"))["deleted"] == 4 and sinks.read(spark, t).count() == 5
