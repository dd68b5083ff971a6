"""Sources: source trees, manifests, payloads and exports, read by Spark's own readers with fixed schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

DOMAINS = "domains array<struct<domain_id:string,name:string,description:string,path_globs:array<string>>>, domain_edges array<struct<from_domain:string,to_domain:string,kind:string,evidence:string>>, exclusions array<string>"
RULE = "name string, category string, priority string, source string, plainEnglish string, ruleClass string, pattern string, statement string, modality string, given string, `when` string, `then` string, `and` string, edgeCases array<string>"
PAYLOAD = f"system string, rounds int, confirmedRules array<struct<{RULE.replace(' string', ':string').replace(' array', ':array')}>>, rules array<struct<{RULE.replace(' string', ':string').replace(' array', ':array')}>>, coverage struct<total:int,claimed:int,uncovered:int,pct:double>"


def source_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), most_bytes: int = 2_000_000) -> DataFrame:
    """relative_path, language, sha256, size_bytes, modified, text of the files under root: excluded globs go first, then only
    included ones (if any are given), then known languages, then the size cap."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = "^.*?" + re.escape(root.split("://")[-1].rstrip("/")) + "/"
    rows = files.withColumn("relative_path", F.regexp_replace("path", inside, ""))
    return classified(rows, include, exclude, most_bytes).select("relative_path", "language", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def _any(path: Column, globs) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(X.glob_regex(g))
    return hit


def classified(rows: DataFrame, include=(), exclude=(), most_bytes: int = 2_000_000) -> DataFrame:
    """Rows (relative_path, length) that discovery keeps, with their language."""
    p = F.col("relative_path")
    kept = rows.filter(~_any(p, exclude)).filter(_any(p, include) if include else F.lit(True))
    return kept.withColumn("language", X.language(p)).filter(F.col("language").isNotNull() & (F.col("length") <= most_bytes))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """The domain catalogue; a file that does not fit the schema fails."""
    return spark.read.schema(DOMAINS).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def parsed_domains(lines: DataFrame, column: str) -> DataFrame:
    """lines with column, the text of a domain catalogue a row, parsed by the same schema; a text that is no JSON fails."""
    return lines.withColumn(column, F.from_json(column, DOMAINS, {"mode": "FAILFAST"}))


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """ordinal and the fields of each rule of an extractor payload; rules may stand under either of two keys."""
    rows = spark.read.schema(PAYLOAD).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.select("system", F.posexplode(F.coalesce("rules", "confirmedRules")).alias("ordinal", "r")).select("system", "ordinal", "r.*")


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of an export as rows; blank lines and objects without gr_id are left out."""
    return spark.read.schema(schema).json(path).filter("gr_id IS NOT NULL")


def write_export(lines: DataFrame, path: str) -> None:
    """One line a row in the order of its key; range partitions keep the order across files, whatever the size."""
    lines.repartitionByRange("key").sortWithinPartitions("key").select("line").write.text(path)
