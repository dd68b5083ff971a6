"""Reports: grouped counts, facets, fill counts, pages, set operations and change splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_null_last(df: DataFrame, column: str) -> DataFrame:
    """value, n of each value; null is a group of its own, the last one."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("value").isNull(), "value")


def group_coalesce(df: DataFrame, column: str, none: str = "(none)") -> DataFrame:
    """value, n with null as a value, the most frequent first."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(none)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n of the values (not null) of several columns, in one pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("s"))
    return long.filter("s.value IS NOT NULL").groupBy("s.facet", "s.value").agg(F.count(F.lit(1)).alias("n"))


def fill_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, filled, empty, absent: three counts that differ, in one pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("s"))
    filled = F.count_if((F.col("s.v") != "") & F.col("s.v").isNotNull())
    return long.groupBy("s.column_name").agg(filled.alias("filled"), F.count_if(F.col("s.v") == "").alias("empty"), F.count_if(F.col("s.v").isNull()).alias("absent"))


def fill_rates(counts: DataFrame, also_empty: tuple[str, ...] = ()) -> DataFrame:
    """column_name, rate in percent; for some columns an empty value counts as an answer; null over no rows."""
    total = F.col("filled") + F.col("empty") + F.col("absent")
    part = F.when(F.col("column_name").isin(*also_empty), F.col("filled") + F.col("empty")).otherwise(F.col("filled"))
    return counts.select("column_name", F.round(100.0 * part / F.nullif(total, F.lit(0)), 4).alias("rate"))


def filtered(df: DataFrame, limit: int | None = None, order: str | None = None, **equal) -> DataFrame:
    """Rows that equal all given values; None does not filter."""
    rows = reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None), df)
    rows = rows.orderBy(order) if order else rows
    return rows if limit is None else rows.limit(limit)


def by_name(df: DataFrame, column: str, name: str, key: str, limit: int = 50) -> DataFrame:
    """Rows with exactly that name; only if there are none, those that contain it, whatever the case; % and _ in it stand for
    any characters and for any one."""
    exact = df.filter(F.col(column) == name)
    some = exact.limit(1).select(F.lit(1).alias("one"))
    like = df.filter(F.lower(F.col(column)).like("%" + name.lower().replace("\\", "\\\\") + "%")).join(F.broadcast(some), F.lit(True), "left_anti")
    return exact.unionByName(like).orderBy(column, key).limit(limit)


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page of a total order, pages from 1; size within 1 to 500."""
    size = min(500, max(1, size))
    return df.orderBy(*order).offset(size * (max(1, number) - 1)).limit(size)


def majority(rows: DataFrame, key: str, value: str, sentinels: tuple[str, ...]) -> DataFrame:
    """key, winner, how: the value of more than half of the rows that are no sentinel; a tie is no majority."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    real = ~F.col(value).isin(*sentinels) & F.col(value).isNotNull()
    out = counts.groupBy(key).agg(F.sum(F.when(real, F.col("c")).otherwise(0)).alias("total"), F.max(F.when(real, F.struct("c", value))).alias("top"))
    wins = F.col("top.c") * 2 > F.col("total")
    return out.select(key, F.when(wins, F.col(f"top.{value}")).alias("winner"), F.when(wins, "majority").when(F.col("total") == 0, "none").otherwise("tie").alias("how"))


def derive_subject(citations: DataFrame, statements: DataFrame, key: str) -> DataFrame:
    """key, subject, subject_provenance of statements (key and the validator's COLUMNS): derived, the domain of more than half
    of its citations (key, domain; a row a citation) that have one; else the subject slot of the statement, llm_named if all
    citations are unassigned, derived_ambiguous if not."""
    from .validate import COLUMNS, read

    how = majority(citations, key, "domain", ("unassigned", "excluded")).select(key, "winner")
    alone = citations.groupBy(key).agg(F.every(F.coalesce(F.col("domain") == "unassigned", F.lit(False))).alias("alone"))
    slot = read(statements.select(key, *COLUMNS)).select(key, F.substring(F.col("text"), F.col("subject.start") + 1, F.col("subject.end") - F.col("subject.start")).alias("said"))
    rows = slot.join(how, key, "left").join(alone, key, "left")
    provenance = F.when(F.col("winner").isNotNull(), "derived").when(F.col("alone"), "llm_named").otherwise("derived_ambiguous")
    return rows.select(key, F.coalesce("winner", "said").alias("subject"), provenance.alias("subject_provenance"))


def rederived(stored: DataFrame, citations: DataFrame, statements: DataFrame, key: str) -> DataFrame:
    """key, old_subject, old_provenance, subject, subject_provenance of the rows (key, subject, subject_provenance) that a new
    derivation changes; only these are to be written."""
    old = stored.select(key, F.col("subject").alias("old_subject"), F.col("subject_provenance").alias("old_provenance"))
    both = old.join(derive_subject(citations, statements, key), key)
    return both.filter(~(F.col("old_subject").eqNullSafe(F.col("subject")) & F.col("old_provenance").eqNullSafe(F.col("subject_provenance"))))


def change_split(stored: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: added, deleted, changed or unchanged."""
    both = stored.select(key, F.col(digest).alias("old"), F.lit(True).alias("was")).join(found.select(key, F.col(digest).alias("new"), F.lit(True).alias("is")), key, "full_outer")
    return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed").alias("status"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def cascade(children: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """children without those of parents that are gone."""
    return children.join(gone.select(*keys), keys, "left_anti")


def first_seen(df: DataFrame, digest: str, key: str) -> DataFrame:
    """digest, first_id, members: the first row of each text and how many it stands for."""
    return df.groupBy(digest).agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("members"))


#: The named orders of a list of requirements.
ORDERS = ("priority", "errors", "confidence", "name", "subject", "id")


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """rows (gr_id, priority, errors, confidence_extraction, name, subject) in a named order; an unknown name means priority.
    A full sort: Spark deals ranges, so no task holds all rows."""
    last = lambda column, *values: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0)), F.lit(len(values) + 1))
    urgent, unsure = last("priority", "P0", "P1"), last("confidence_extraction", "Low", "Medium")
    by = {"priority": [urgent, F.desc("errors"), "name"], "errors": [F.desc("errors"), urgent, "name"], "confidence": [unsure, "name"], "name": ["name"], "subject": ["subject", "name"], "id": ["gr_id"]}
    return rows.orderBy(*by.get(name.lower(), by["priority"]))


def set_hash(df: DataFrame, item: Column) -> DataFrame:
    """One row: the digest of all items in order. Items are hashed within 16^5 buckets (by their own digests), these within 256,
    these together, so that no task holds more than a millionth of the items as text."""
    digest = lambda column: F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ""), 256)
    rows = df.select(item.alias("item")).select("item", F.substring(F.sha2("item", 256), 1, 5).alias("bucket"))
    fine = rows.groupBy("bucket").agg(digest("item").alias("h"))
    coarse = fine.groupBy(F.substring("bucket", 1, 2).alias("top")).agg(digest(F.concat("bucket", "h")).alias("h"))
    return coarse.agg(digest(F.concat("top", "h")).alias("set_hash"))


def numbered(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1..n over a bounded ranking."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
