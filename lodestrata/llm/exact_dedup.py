"""Exact deduplication with streaming state.

Every document offers (digest, identifier, locator) to a Structured Streaming aggregation whose state lies on disk
(RocksDB, with its change log in the checkpoint folder) and never expires. The state keeps for each digest the row
that stays (largest identifier, then largest locator) and the number of rows. Rows whose digest was hit more than once
are then compared byte by byte; a digest that two different texts share is split by the texts themselves.

Only DataFrame operations: no Python runs on executors. Copies are combined in each task before they are shuffled,
so that one text may hold any share of the rows.

Defined results: a null text counts as empty; a null doc_id is smaller than all others; of repeated rows (same
doc_id, same text) one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, drop_folder, fresh_name, materialise, work_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: Offers for each partition of the state. A partition is a RocksDB instance with files of its own, so their number
#: follows the rows, not the session's shuffle partitions. It holds for all later offers as well.
OFFERS = 500_000


class DedupState:
    """The keyed state of one deduplication, in a shared folder; further offers may follow at any time."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def offer(self, offers: DataFrame) -> None:
        """Takes rows (digest, doc_id, locator) into the state. offers is written first: that is the stream's source."""
        offers.write.mode("append").parquet(f"{self.folder}/offers")
        n = self.spark.read.schema(offers.schema).parquet(f"{self.folder}/offers").count()
        settings = STATE_CONF | {"spark.sql.streaming.internal.stateStore.partitions": str(max(self.spark.sparkContext.defaultParallelism, n // OFFERS))}
        before = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            groups = (
                self.spark.readStream.schema(offers.schema).parquet(f"{self.folder}/offers")
                .groupBy("digest")
                .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "locator")).alias("keep"))
            )
            changed = f"{self.folder}/changed"
            query = (
                groups.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.folder}/state")
                .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{changed}/batch={n}"))
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def groups(self) -> DataFrame:
        """digest, group_size, keep: the state as the last batch that changed each digest left it."""
        schema = f"digest string, group_size long, keep struct<doc_id:{self.id_type()},locator:long>, batch long"
        changed = self.spark.read.schema(schema).parquet(f"{self.folder}/changed")
        return changed.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("keep").alias("keep"))

    def id_type(self) -> str:
        return self.spark.read.parquet(f"{self.folder}/offers").schema["doc_id"].dataType.simpleString()


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256. digest maps normalised text to a string key."""
    spark = docs.sparkSession
    folder = work_folder(spark)
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", digest(text).alias("digest"), sha256(text).alias("text_sha256"))
    offers = materialise(rows.withColumn("locator", F.monotonically_increasing_id()), f"{folder}/rows")
    state = DedupState(spark, f"{folder}/dedup")
    state.offer(offers.select("digest", "doc_id", "locator"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("locator") == F.col("keep.locator"))
    groups = materialise(state.groups(), f"{folder}/groups")  # a plain table: Spark can then split a hot digest's rows in the join
    decided = offers.join(groups, "digest").select("digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")
    decided = materialise(decided, f"{folder}/decided")
    mixed = _mixed(docs, decided, digest, f"{folder}/mixed")
    if not mixed.isEmpty():
        decided = materialise(_split(docs, decided, mixed, digest, f"{folder}/texts"), f"{folder}/split")
    for name in ("rows", "dedup", "groups"):
        drop_folder(spark, f"{folder}/{name}")
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _mixed(docs: DataFrame, decided: DataFrame, digest: Callable[[Column], Column], path: str) -> DataFrame:
    """Digests under which the full bytes differ.

    Only texts of rows that hit a digest are fetched, by identifier; Spark puts a Bloom filter of these before the
    shuffle where their table is small enough. Least and greatest text of a digest are combined in each task first.
    """
    spark, key = docs.sparkSession, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    hits = decided.filter(F.col("group_size") > 1).select("doc_id")
    mine = docs.select("doc_id", "text")
    mine = mine.join(hits, "doc_id", "left_semi").unionByName(mine.filter("doc_id is null"))
    text = normalised(F.col("text"))
    both = mine.select(digest(text).alias("digest"), text.alias("bytes")).groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    before = spark.conf.get(key)
    spark.conf.set(key, "1b")
    try:
        return materialise(both.filter(F.col("least") != F.col("most")).select("digest"), path)
    finally:
        spark.conf.set(key, before)


def _split(docs: DataFrame, decided: DataFrame, mixed: DataFrame, digest: Callable[[Column], Column], path: str) -> DataFrame:
    """decided, with the rows of the mixed digests decided anew by (digest, text)."""
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", digest(text).alias("digest"), text.alias("bytes")).join(mixed, "digest", "left_semi")
    rows = materialise(rows.withColumn("locator", F.monotonically_increasing_id()), path)
    groups = rows.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "locator")).alias("keep"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("locator") == F.col("keep.locator"))
    anew = rows.join(groups, ["digest", "bytes"]).select("digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), sha256(F.col("bytes")).alias("text_sha256"))
    return decided.join(mixed, "digest", "left_anti").unionByName(anew)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops, with their own columns; one row each of repeated rows."""
    names = docs.columns
    key, one = fresh_name("text_sha256", names), fresh_name("one", names)
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias(key))
    rows = docs.withColumn(key, sha256(normalised(F.col("text"))))
    known = rows.join(kept, ["doc_id", key], "left_semi").groupBy("doc_id", key).agg(F.first(F.struct(*names)).alias(one))  # dealt as the join is
    unknown = rows.filter("doc_id is null").join(kept.filter("doc_id is null").select(key), key, "left_semi").groupBy(key).agg(F.first(F.struct(*names)).alias(one))
    return known.select(f"{one}.*").unionByName(unknown.select(f"{one}.*"))
