"""Extraction: regular expressions by line, facts, citations and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from .intervals import WHOLE_FILE


def matches_by_line(files: DataFrame, key: str, text: str, pattern: str, group: int = 1) -> DataFrame:
    """key, line (from 1), name of each match."""
    rows = files.select(key, F.posexplode(lines(F.col(text))).alias("i", "t")).filter(F.col("t").rlike(pattern))
    return rows.select(key, (F.col("i") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("t", F.lit(pattern), F.lit(group))).alias("name"))


def facts(files: DataFrame, key: str, text: str, pattern: str, intents: dict[str, str]) -> DataFrame:
    """key, predicate, n, confidence: what a pattern finds, by intent; facts found by pattern have confidence 0.9."""
    table = F.create_map(*(F.lit(x) for kv in intents.items() for x in kv))
    found = files.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("name"))
    return found.groupBy(key, F.coalesce(table[F.col("name")], F.lit("has_annotation")).alias("predicate")).agg(F.count(F.lit(1)).alias("n")).withColumn("confidence", F.lit(0.9))


def symbol_gate(spans: DataFrame, totals: DataFrame, key: str, most_tokens: int, least: float = 0.30) -> DataFrame:
    """Per file, whether its symbol chunks (not over twice most_tokens) cover enough lines."""
    kept = spans.filter(F.col("tokens") <= 2 * most_tokens).groupBy(key).agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("symbol_lines"))
    return kept.join(totals, key).select(key, "symbol_lines", F.col("total").cast("long").alias("total_lines"), (F.col("symbol_lines") / F.col("total") >= least).alias("accepted"))


def source_slice(text: Column, start: Column, end: Column, around: int = 8) -> Column:
    first = F.greatest(F.lit(1), (start - around).cast("int"))
    return F.array_join(F.slice(lines(text), first, (end + around - first + 1).cast("int")), "\n")


def entity_body(text: Column, first: Column, last: Column, start_line: Column, end_line: Column) -> Column:
    """By offsets in bytes of UTF-8 if they are a span of the text, else by lines if they are, else null; bytes that are cut
    out of a character become U+FFFD."""
    by_offset = (first >= 0) & (last > first) & (last <= F.octet_length(text))
    by_line = (start_line >= 1) & (end_line >= start_line) & (end_line <= F.size(lines(text)))
    part = F.array_join(F.slice(lines(text), start_line, end_line - start_line + 1), "\n")
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), first + 1, last - first).cast("string"))
    return F.when(by_offset, cut).when(by_line, part)


RANGE = r"[0-9]+(?:-[0-9]*)?"
RANGES = rf"{RANGE}(?:\s*,\s*{RANGE})*"


def citations(rows: DataFrame, key: str, raw: str, strict: bool = False) -> DataFrame:
    """key, path, start_line, end_line of citations, a JSON array of texts or a line each, list marks aside.

    An entry is path:a-b,c (all of a list must be ranges), several such citations with commas between them (all must be
    whole), or a path alone, which is the whole file; so is what ends like ranges but is none. strict fails there, and for a
    broken array and an entry without a path, which are left out else."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    listed, fail = text.startswith("["), lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), text))
    array = F.from_json(text, "array<string>")
    broken = fail("no array of citations") if strict else F.array().cast("array<string>")
    entries = F.when(listed, F.coalesce(array, broken)).otherwise(F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c]"), lambda e: F.trim(e)), lambda e: e != ""))
    e = rows.select(key, F.explode(F.transform(entries, lambda e: F.regexp_replace(F.regexp_replace(e, r"^[-*•\s]+", ""), r"\s+$", ""))).alias("e"))
    e = e.filter(F.when(F.col("e") != "", True).otherwise(F.raise_error(F.lit("a citation without a path")).cast("boolean") if strict else F.lit(False)))
    one = rf"\s*[^,]+:{RANGES}"
    several = F.col("e").rlike(rf"^{one}(?:\s*,{one})+\s*$")
    cut = F.transform(F.split("e", rf",(?!\s*{RANGE}\s*(?:,|$))"), lambda x: F.regexp_replace(F.trim(x), r"\s*,\s*", ","))
    e = e.select(key, F.explode(F.when(several, cut).otherwise(F.array("e"))).alias("e"))
    tail = F.regexp_extract("e", r"(?s)^.*:\s*([-0-9,]+)\s*$", 1)
    e = e.select(key, "e", tail.alias("tail"), tail.rlike(rf"^{RANGE}(?:,{RANGE})*$").alias("good"))
    if strict:
        e = e.filter(F.when((F.col("tail") == "") | F.col("good"), True).otherwise(F.raise_error(F.concat(F.lit("no ranges: "), "e")).cast("boolean")))
    path = F.when(F.col("good"), F.regexp_extract("e", r"(?s)^(.*):\s*[-0-9,]+\s*$", 1)).otherwise(F.col("e"))
    e = e.select(key, F.trim(path).alias("path"), F.explode(F.when(F.col("good"), F.split("tail", ",")).otherwise(F.array(F.lit(None).cast("string")))).alias("p"))
    a, b = F.regexp_extract("p", r"([0-9]+)", 1), F.regexp_extract("p", r"-([0-9]+)", 1)
    start = F.when(F.col("p").isNull(), 1).otherwise(a.cast("long"))
    end = F.when(F.col("p").isNull(), WHOLE_FILE).otherwise(F.coalesce(F.nullif(b, F.lit("")), a).cast("long"))
    return e.select(key, "path", start.cast("long").alias("start_line"), end.cast("long").alias("end_line"))
