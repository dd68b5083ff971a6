"""Queries that write tables by key and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks as W
from ..operators.store import run_audit
from ..tables import work_folder
from .catalog import query, table


def _made(spark, schema, *keys):
    made = W.Table(work_folder(spark), schema, keys, 8)
    W.create(spark, made)
    return made


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_nationkey, -1.0 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 100000000, c_nationkey, -1.0 FROM customer WHERE c_custkey % 50 = 0")
def sk1_written_upsert(spark, d):
    """Customers written, a tenth of them written again with another balance, and some new ones, twice."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    t = _made(spark, "c_custkey long, c_nationkey long, c_acctbal double", "c_custkey")
    W.upsert(spark, t, c)
    new = c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(-1.0))
    new = new.unionByName(new.filter("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 100000000))
    W.upsert(spark, t, new)
    W.upsert(spark, t, new)
    return W.read(spark, t)


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sk3_written_cascade(spark, d):
    """Lines of orders written, equal ones once, and those of finished orders taken out again."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    t = _made(spark, "l_orderkey long, l_linenumber long, l_partkey long", "l_orderkey", "l_linenumber", "l_partkey")
    W.upsert(spark, t, rows)
    finished = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    W.delete(spark, t, rows.join(finished, "l_orderkey", "left_semi"))
    return W.read(spark, t)


@query("SELECT run_id, outcome, count(*) AS hits, min(event_id) AS first_offer FROM (SELECT user_id % 10 AS run_id, event_type AS outcome, event_id FROM events) GROUP BY 1, 2")
def sk10_written_audit(spark, d):
    """Audit rows of each half of the runs put into a table, the second half twice."""
    hits = table(spark, d, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("outcome"), F.col("event_id").alias("ordinal"))
    t = _made(spark, "run_id long, outcome string, hits long, first_offer long", "run_id", "outcome")
    for part in ("run_id < 5", "run_id >= 5", "run_id >= 5"):
        W.upsert(spark, t, run_audit(hits.filter(part)))
    return W.read(spark, t)
