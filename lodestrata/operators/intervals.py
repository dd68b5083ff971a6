"""Closed line intervals: overlap joins, coverage, innermost containment and anchors, by a range index.

A range has a level by its length, so that it touches two buckets of its level at most, each as wide as the longest range
of the level. Two ranges that overlap meet in one bucket: the shorter one looks the longer one up at the
longer one's level, in the bucket where the later of them starts. So every join is an equality of (key, level, bucket):
what is looked at grows with the ranges of similar length around a line, not with the file, and no file is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

WHOLE_FILE = 2**31 - 1


def windows(files: DataFrame, key: str, text: str, most: int = 120, overlap: int = 12) -> DataFrame:
    """Windows of at most `most` lines with an overlap; the last one ends with the text: key, chunk, start, end, text."""
    stride = max(1, most - overlap)
    rows = files.select(key, X.lines(F.col(text)).alias("l"))
    last = F.ceil(F.greatest(F.size("l") - most, F.lit(0)) / stride).cast("int")
    rows = rows.select(key, "l", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.slice("l", F.col("chunk") * stride + 1, most)
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * stride + 1).cast("long").alias("start_line"), (F.col("chunk") * stride + F.size(part)).cast("long").alias("end_line"), F.array_join(part, "\n").alias("chunk_text"))


def chunked(files: DataFrame, symbols: DataFrame, key: str, text: str, most_tokens: int = 1400, lines: int = 120, again: int = 12, least: float = 0.30) -> DataFrame:
    """key, kind, start_line, end_line, chunk_text: a file's symbols (key, start, end: offsets, start_line, end_line) that are
    not blank and have 2 * most_tokens tokens at most, if these cover enough of its lines; else its windows."""
    cut = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    spans = symbols.filter("start < end AND start_line <= end_line").join(files.select(key, text), key).withColumn("chunk_text", cut)
    spans = spans.filter((F.trim(F.translate("chunk_text", "\n\r\t", "   ")) != "") & (X.token_estimate(F.col("chunk_text")) <= 2 * most_tokens))
    totals = files.select(key, F.size(X.lines(F.col(text))).alias("total"))
    good = spans.groupBy(key).agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("covered")).join(totals, key).filter(F.col("covered") / F.col("total") >= least).select(key)
    own = spans.join(good, key, "left_semi").select(key, F.lit("symbol").alias("kind"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "chunk_text")
    rest = windows(files.join(good, key, "left_anti"), key, text, lines, again).select(key, F.lit("window").alias("kind"), "start_line", "end_line", "chunk_text")
    return own.unionByName(rest)


#: Levels of the index: 2 to the power of each is the width of a bucket. What is longer than all but the last is on the last.
LEVELS = (0, 3, 6, 9, 12, 15, 18, 33)


def _low() -> Column:
    return F.least("start_line", "end_line")


def _high() -> Column:
    return F.greatest("start_line", "end_line")


def _level() -> Column:
    """The first level whose buckets are as wide as the range is long."""
    out = F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        out = F.when(_high() - _low() < 1 << level, level).otherwise(out)
    return F.when(_high().isNotNull(), out)


def _placed(rows: DataFrame, key: str, name: str, part_0: str, part_1: str = "array()", to: str = "hi") -> DataFrame:
    """rows as a struct, in the buckets (two at most) that their lines touch at the levels wanted in each part; what is wanted
    is SQL over own, the row's level, and levels, all there are."""
    lines = F.struct(*rows.columns).alias(name), F.col(key).alias("k"), _level().alias("own"), _low().cast("long").alias("lo"), _high().cast("long").alias("hi")
    whole = rows.filter("start_line IS NOT NULL AND end_line IS NOT NULL").select(*lines, F.array(*map(F.lit, LEVELS)).alias("levels"))
    wanted = f"concat(transform({part_0}, x -> 2 * x), transform({part_1}, x -> 2 * cast(x AS int) + 1))"  # level and part
    bucket = lambda line: f"struct(y AS at, shiftright({line}, cast(y div 2 AS int)) AS b)"
    places = F.expr(f"explode(flatten(transform({wanted}, y -> array_distinct(array({bucket('lo')}, {bucket(to)})))))")
    return whole.select(name, "k", places.alias("p")).select(name, "k", "p.at", "p.b")


def overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.start_line") <= F.col(f"{b}.end_line")) & (F.col(f"{a}.end_line") >= F.col(f"{b}.start_line"))


def meeting(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """r, s: structs of all pairs of a range and a span of the same key that overlap, each once."""
    low = lambda x: F.least(f"{x}.start_line", f"{x}.end_line")
    # Part 0: a range looks up spans that are on its level or above; part 1: a span looks up ranges above its level.
    a = _placed(ranges, key, "r", "filter(levels, x -> x >= own)", "array(own)")
    b = _placed(spans, key, "s", "array(own)", "filter(levels, x -> x > own)")
    later = F.call_function("shiftright", F.greatest(low("r"), low("s")).cast("long"), F.expr("cast(at div 2 AS int)"))
    return a.join(b, ["k", "at", "b"]).filter((F.col("b") == later) & overlap("r", "s")).select("r", "s")


def overlapping(ranges: DataFrame, spans: DataFrame, key: str, range_id: str) -> DataFrame:
    """r, s: structs of each range with the spans of the same key that it overlaps; s is null if there is none."""
    found = meeting(ranges, spans, key)
    alone = ranges.join(found.select(F.col(f"r.{range_id}").alias(range_id)), range_id, "left_anti")
    return found.unionByName(alone.select(F.struct(*ranges.columns).alias("r"), F.lit(None).cast(found.schema["s"].dataType).alias("s")))


def looked_up(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """r, s, k, at, b: ranges with the spans in the buckets where they start, on their own level and above."""
    return _placed(ranges, key, "r", "filter(levels, x -> x >= own)", to="lo").join(_placed(spans, key, "s", "array(own)"), ["k", "at", "b"])


def containing(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """r, s: structs of all pairs of a range and a span of the same key that contains it. A span that does is as long as the range
    at least, so a range looks up the one bucket of each level in which it starts."""
    return looked_up(ranges, spans, key).select("r", "s").filter((F.col("s.start_line") <= F.col("r.start_line")) & (F.col("s.end_line") >= F.col("r.end_line")))


def innermost(ranges: DataFrame, spans: DataFrame, key: str, range_id: str, span_id: str) -> DataFrame:
    """For each range the tightest span that contains it (span, then start, then id); null if none does.

    Ranges of the same lines have the same answer, and of spans of the same lines only the first counts: both are taken once."""
    place = [key, "start_line", "end_line"]
    lines = ranges.select(*place).distinct()
    first = spans.groupBy(*place).agg(F.min(span_id).alias("_id")).withColumnRenamed("_id", "id")
    order = F.struct((F.col("s.end_line") - F.col("s.start_line")).alias("span"), F.col("s.start_line").alias("start"), F.col("s.id").alias("id"))
    best = containing(lines, first, key).groupBy(*(F.col(f"r.{c}").alias(c) for c in place)).agg(F.min(order).alias("b"))
    return ranges.join(best, place, "left").select(range_id, F.col("b.id").alias(span_id), F.col("b.span").cast("long").alias("span"))


def anchors(citations: DataFrame, files: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """citation_id, resolution, anchor: unresolved (no file), file (whole file, changed file or no overlap), else the innermost
    containing span, else the smallest one that intersects; with how it does."""
    known = citations.join(files.select(key, F.col("current")), key, "left")
    part = known.filter(F.col("current") & (F.col("end_line") != WHOLE_FILE)).select("citation_id", key, "start_line", "end_line")
    contains = (F.col("s.start_line") <= F.col("r.start_line")) & (F.col("s.end_line") >= F.col("r.end_line"))
    best = F.min(F.struct((~contains).cast("int").alias("o"), (F.col("s.end_line") - F.col("s.start_line")).alias("n"), F.col("s.start_line").alias("b"), F.col("s.span_id").alias("id")))
    hit = meeting(part, spans, key).groupBy(F.col("r.citation_id").alias("citation_id")).agg(best.alias("b"))
    how = F.when(F.col("current").isNull(), "unresolved").when(F.col("b").isNull(), "file").when(F.col("b.o") == 0, "contains").otherwise("intersects")
    return known.join(hit, "citation_id", "left").select("citation_id", how.alias("resolution"), F.col("b.id").alias("span_id"))


def coverage(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """chunks (chunk_id, path, start_line, end_line) with claimed: some citation (path, start_line, end_line, in either
    order) has the same base name, one path is a component suffix of the other, and the lines overlap."""
    parts = lambda df: df.withColumn("p", F.array_join(X.path_parts(F.col("path")), "/")).withColumn("base", F.element_at(F.split("p", "/"), -1))
    c = parts(citations.select("path", _low().alias("start_line"), _high().alias("end_line"))).distinct()
    ends = lambda a, b: F.concat(F.lit("/"), F.col(f"{a}.p")).endswith(F.concat(F.lit("/"), F.col(f"{b}.p")))
    claimed = meeting(c, parts(chunks), "base").filter(ends("r", "s") | ends("s", "r")).select("s.chunk_id").distinct().withColumn("claimed", F.lit(True))
    return chunks.join(claimed, "chunk_id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))


def uncovered(covered: DataFrame) -> DataFrame:
    """Unclaimed chunks, the longest first, then path and start."""
    rows = covered.filter("NOT claimed").withColumn("span", F.col("end_line") - F.col("start_line") + 1)
    return rows.orderBy(F.desc("span"), "path", "start_line")


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("place = 1").drop("place")
