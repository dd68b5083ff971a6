"""Business domains: ordered globs, manual tags first, freshness and the domain diagram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def resolve_globs(files: DataFrame, patterns: list[tuple[str, str]], path: str) -> DataFrame:
    """files with domain (of the first pattern that matches) and matches (of how many domains)."""
    hits = [F.when(F.col(path).rlike(glob_regex(g)), F.lit(d)) for g, d in patterns]
    found = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())) if hits else F.array().cast("array<string>")
    return files.withColumn("domain", F.get(found, F.lit(0))).withColumn("matches", F.size(found).cast("long"))


def reconcile(files: DataFrame, patterns: list[tuple[str, str]], manual: DataFrame, path: str) -> DataFrame:
    """path, domain, source: a manual tag wins; tags of files that are not there go; no match is unassigned."""
    rows = resolve_globs(files, patterns, path).join(manual.select(path, F.col("domain").alias("by_hand")), path, "left")
    source = F.when(F.col("by_hand").isNotNull(), "manual").when(F.col("domain").isNotNull(), "glob").otherwise("none")
    return rows.select(path, F.coalesce("by_hand", "domain", F.lit("unassigned")).alias("domain"), source.alias("source"))


def freshness(tagged: DataFrame) -> DataFrame:
    """One row: discovered = classified + unassigned + excluded + untagged, and the ratio over what is not excluded."""
    d = F.col("domain")
    counts = tagged.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(d == "excluded").alias("excluded"), F.count_if(d == "unassigned").alias("unassigned"), F.count_if(d.isNull()).alias("untagged"))
    classified = F.col("discovered") - F.col("excluded") - F.col("unassigned") - F.col("untagged")
    return counts.select("*", classified.alias("classified"), F.round(100.0 * classified / F.greatest(F.lit(1), F.col("discovered") - F.col("excluded")), 4).alias("coverage_pct"))


def mermaid(domains: DataFrame, edges: DataFrame) -> DataFrame:
    """ordinal, line of the diagram: nodes, then edges between known domains, each in order; shared ones are rounded."""
    shape = F.when(F.col("kind").isin("shared", "core"), F.format_string('    %s(["%s"])', "domain_id", "name")).otherwise(F.format_string('    %s["%s"]', "domain_id", "name"))
    nodes = domains.select(F.lit(1).alias("part"), F.col("domain_id").alias("a"), F.lit("").alias("b"), shape.alias("line"))
    known = domains.select("domain_id")
    edges = edges.join(known.withColumnRenamed("domain_id", "from_domain"), "from_domain", "left_semi").join(known.withColumnRenamed("domain_id", "to_domain"), "to_domain", "left_semi")
    lines = edges.select(F.lit(2).alias("part"), F.col("from_domain").alias("a"), F.col("to_domain").alias("b"), F.format_string("    %s -->|%s| %s", "from_domain", "label", "to_domain").alias("line"))
    head = domains.sparkSession.createDataFrame([(0, "", "", "flowchart LR")], "part int, a string, b string, line string")
    return head.unionByName(nodes).unionByName(lines).orderBy("part", "a", "b", "line").select("line")
