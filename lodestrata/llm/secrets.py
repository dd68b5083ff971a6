"""Secret scan: patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the characters 33 to 126 are trained from labelled samples: random strings, and ordinary
identifiers. A candidate is a secret if the mean log ratio of its transitions is over a threshold. Candidates are runs of
LEAST or more key characters, and parts of letters and digits (PART or more, both among them) of runs that do not count
or are shorter, so that a secret in a path or joined to a name is not averaged away; a part shorter than LEAST needs more
(STRICT). Parts are looked for run by run. Training and scoring are DataFrame expressions: no Python runs on executors. The models are tables
of 94 x 94 ratios whatever the input; they become one constant array in the plan.

Match offsets come from lengths: the text split at the matches gives what lies between them. The sums of lengths are
taken in two levels of BLOCK, so that a text with n matches costs n * BLOCK, not n * n. Map-only.

Kinds, in order: assign, access, hex (the patterns of the contract; failing matches are dropped) and random.

Defined results: a null or empty text has no spans; rows are independent; an empty table gives an empty one, and a model
without ordinary samples scores by the random ones alone; other columns are ignored unless kept by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = "(?i:password|passwd|secret|token|api_?key)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Candidates for the models: shorter runs are not told apart well.
LEAST = 20
KINDS = ("assign", "access", "hex", "random")
BLOCK, SIZE, FIRST = 128, 94, 33
#: Ordinary documents that the model is trained from, about; random strings made for it.
ORDINARY_DOCS, RANDOM_STRINGS = 400, 4000
#: Mean log-likelihood ratio of a transition from which a candidate counts as random.
THRESHOLD = 0.5
#: Least characters of a part of a run; the ratio from which one shorter than LEAST counts.
PART, STRICT = 12, 1.5
FIELD = f"[A-Za-z0-9+/_=-]{{{PART},}}"
SEGMENT = f"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{{{PART},}}"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda captures would be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column) -> Column:
    """The sum of all lengths before each place; lengths is a lambda's variable."""
    zero = F.lit(0).cast("int")

    def total(start, size):
        return F.aggregate(F.slice(lengths, start, size), zero, lambda a, x: a + x)

    n = F.size(lengths)
    blocks = F.transform(F.sequence(zero, F.floor((F.greatest(n, F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: total(b * BLOCK + 1, F.lit(BLOCK)))
    before = F.aggregate(blocks, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    places = F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
    return let(before, lambda before: F.transform(places, lambda i: F.get(before, F.floor(i / BLOCK).cast("int")) + total(F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, match) of a pattern's matches, leftmost first, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))

    def placed(v):
        lengths = F.zip_with(v["gaps"], F.transform(v["hits"], lambda h: F.char_length(h)), lambda g, h: F.coalesce(g, F.lit(0)) + F.coalesce(h, F.lit(0)))
        starts = F.zip_with(let(lengths, _starts), v["gaps"], lambda s, g: s + g)
        return F.zip_with(F.slice(starts, 1, F.size(v["hits"])), v["hits"], lambda s, h: F.struct(s.alias("start"), (s + F.char_length(h)).alias("end"), h.alias("match")))

    return let(F.struct(hits.alias("hits"), gaps.alias("gaps")), placed)


def labelled_samples(docs: DataFrame, ordinary_docs: int = ORDINARY_DOCS, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """sample, is_random. Random: digests in hex and base64, and their letters in one case. Ordinary: the words of about
    ordinary_docs documents, chosen by a hash, singly and joined in pairs as in snake_case and camelCase."""
    spark = docs.sparkSession
    raw = spark.range(random_strings).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("hex"), F.col("id"))
    key = F.translate(F.base64(F.unhex("hex")), "=\r\n", "")
    made = raw.select(F.when(F.col("id") % 4 == 0, F.substring("hex", 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(key, "[^A-Za-z0-9]", ""))).otherwise(key).alias("sample"), F.lit(True).alias("is_random"))
    share = ordinary_docs / max(1, docs.select("doc_id").count())
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)  # rows without an identifier are dealt by their text
    words = docs.select("doc_id", "text").filter(place < share).select(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) > 3).alias("w"))
    plain = words.select(F.explode("w").alias("sample"))
    pairs = words.select(F.explode(F.transform("w", lambda w, i: F.when(i % 2 == 0, F.concat_ws("_", w, F.get(F.col("w"), i + 1))).otherwise(F.concat(F.lower(w), F.initcap(F.get(F.col("w"), i + 1)))))).alias("sample")).filter("sample is not null")
    return made.unionByName(plain.unionByName(pairs).withColumn("is_random", F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """The log ratio of each transition, random over ordinary, add-half smoothed, by (first - 33) * 94 + second - 33."""
    code = F.transform(F.filter(F.split("sample", ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)
    steps = samples.select("is_random", F.explode(F.transform(code, lambda c, i: F.struct(c.alias("a"), F.get(code, i + 1).alias("b")))).alias("s"))
    inside = (F.col("s.a").between(0, SIZE - 1)) & (F.col("s.b").between(0, SIZE - 1))
    counts = steps.filter(inside).groupBy("is_random", (F.col("s.a") * SIZE + F.col("s.b")).alias("step")).count().collect()  # 2 * 94 * 94 rows at most
    table = {True: [0.5] * SIZE**2, False: [0.5] * SIZE**2}
    for r in counts:
        table[r["is_random"]][r["step"]] += r["count"]
    import math

    rows = {k: [sum(t[i * SIZE : (i + 1) * SIZE]) for i in range(SIZE)] for k, t in table.items()}
    return [math.log(table[True][i] / rows[True][i // SIZE]) - math.log(table[False][i] / rows[False][i // SIZE]) for i in range(SIZE**2)]


def ratio(token: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's transitions; null for fewer than two characters."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)

    def mean(code):
        steps = F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda a, b: F.coalesce(F.get(table, a * SIZE + b), F.lit(0.0)))
        return F.when(F.size(code) > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (F.size(code) - 1))

    return let(codes, mean)


def _random_spans(field: Column, model: list[float], threshold: float) -> Column:
    """What is random in one run of key characters: the run itself if it is long enough and counts, else its parts that do. A
    part lies in one run, so none is looked for among the others."""

    def span(start: Column, end: Column, score: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(3).alias("kind"), end.alias("end"), F.lit(False).alias("base"), score.alias("score"))

    def told(whole: Column) -> Column:
        hits = F.transform(matches(field["match"], SEGMENT), lambda p: span(field["start"] + p["start"], field["start"] + p["end"], ratio(p["match"], model)))
        parts = F.filter(hits, lambda s: s["score"] > F.when(s["end"] - s["start"] < LEAST, max(STRICT, threshold)).otherwise(threshold))
        none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,score:double>>")
        return F.when(whole > threshold, F.array(span(field["start"], field["end"], whole))).when(F.rlike(field["match"], F.lit(SEGMENT)), parts).otherwise(none)

    return let(F.when(field["end"] - field["start"] >= LEAST, ratio(field["match"], model)), told)


def scan_secrets(docs: DataFrame, model: list[float], keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in keep, and spans: array of (start, kind, end, base, score), by start, then kind as listed.
    kind is an index of KINDS; score is the mean log ratio of a candidate, null for base spans."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def found(pattern, hint=None):
        return F.when(F.rlike("txt", F.lit(hint or pattern)), matches(F.col("txt"), pattern)).otherwise(none)

    def spans(rows, kind, base=True, score=None):
        return F.transform(rows, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"), (score(s) if score else F.lit(None).cast("double")).alias("score")))

    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce("text", F.lit("")).alias("txt"))
    rows = rows.withColumns({"assigned": found(ASSIGN, ASSIGN_HINT), "access": found(ACCESS), "hexes": found(HEX), "fields": found(FIELD)})
    assigned = F.filter("assigned", lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 12)
    more = F.flatten(F.transform("fields", lambda f: _random_spans(f, model, threshold)))
    every = F.array_sort(F.concat(spans(assigned, 0), spans(F.col("access"), 1), spans(F.col("hexes"), 2), more))
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), every.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

