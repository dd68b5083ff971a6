"""Column functions over text: tokens, estimates, windows, snippets, globs, keys and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates parts of a key.
UNIT = "\x1f"
#: What separates tokens in the estimate (fixed values).
ESTIMATE_SPLIT = r"""[\s.,;:()\[\]{}<>"'`!?@#$%^&*+=|\\~]+"""
#: Suffixes of known languages (fixed values).
SUFFIXES = {
    ".cs": "csharp", ".java": "java", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".cbl": "cobol", ".cob": "cobol", ".cpy": "cobol", ".copy": "cobol", ".pco": "cobol", ".sql": "sql", ".ddl": "sql", ".dml": "sql", ".psql": "sql", ".pgsql": "sql", ".tsql": "sql",
    ".xml": "xml", ".jsp": "jsp", ".properties": "properties", ".css": "css", ".vm": "velocity", ".ent": "xml_entity", ".tld": "tld", ".xmi": "xmi",
}


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def token_estimate(text: Column) -> Column:
    """Parts between white space and punctuation."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), ESTIMATE_SPLIT), "")).cast("long")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def snippet(text: Column, radius: int = 8) -> Column:
    """The first 2 * radius lines."""
    return F.array_join(F.slice(lines(text), 1, 2 * radius), "\n")


def body(text: Column) -> Column:
    """Line ends as \\n, lines without trailing white space, without blank lines around."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t\f\x0B]+(?=\n|$)", "")
    return F.regexp_replace(plain, r"^\n+|\n+$", "")


def key(prefix: str, *parts: Column) -> Column:
    """prefix, and 16 hex digits of the digest of the parts; a missing part counts as empty."""
    joined = F.concat_ws(UNIT, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))


def set_text(values: Column) -> Column:
    """The distinct values in order, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(values)), UNIT)


def path_parts(path: Column) -> Column:
    """Components of a path: both slashes separate, empty ones and . go, .. takes its parent away."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^[A-Za-z]:", ""), r"[/\\]+"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    return F.aggregate(parts, none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path's suffix, null if unknown."""
    table = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return table[suffix(path)]


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, *, ? and [classes] do not; without a slash it matches in any
    folder. A bracket that is not closed is a letter."""
    out, i, g = "", 0, glob.lstrip("/")
    while i < len(g):
        if g[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif g[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif g[i] == "[" and (end := g.find("]", i + 2)) > 0:
            negated = g[i + 1] in "!^" and end > i + 2
            out, i = out + f"(?!/)[{'^' * negated}{re.sub(r'([\\[^&])', r'\\\1', g[i + 1 + negated : end])}]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i])), i + 1
    anywhere = "" if "/" in glob.rstrip("/") else "(?:.*/)?"
    return f"^{anywhere}{out}{'.*' if glob.endswith('/') else '(?:/.*)?'}$"


def last_glob(path: Column, globs: list[str]) -> Column:
    """The last glob that matches, ! removed; null if none does or the last one that matches negates."""
    verdict = F.lit(None).cast("string")
    for g in globs:
        verdict = F.when(path.rlike(glob_regex(g.lstrip("!"))), F.lit(None if g.startswith("!") else g).cast("string")).otherwise(verdict)
    return verdict


# Signs of business logic (fixed values): terms of validation and mapping, and patterns of branching and policy.
VALIDATION_TERMS = (
    "required", "stringlength", "maxlength", "minlength", "range", "regularexpression", "emailaddress", "phone", "creditcard", "compare", "validation", "validate", "key", "foreignkey", "column", "table", "index", "notmapped", "concurrencycheck", "timestamp", "datatype",
    "notnull", "notblank", "notempty", "size", "min", "max", "pattern", "valid", "validated", "positive", "negative", "past", "future", "digits", "assert", "constraint", "entity", "joincolumn", "onetomany", "manytoone", "manytomany",
    "validator", "field_validator", "constr", "conint",
)
LOGIC = (
    r"\bif\b", r"\belse\b", r"\bswitch\b", r"\bcase\b", r"\bfor\b", r"\bforeach\b", r"\bwhile\b", r"\breturn\b.*[<>=!]", r"\bthrow\b", r"\braise\b", r"==|!=|<=|>=|&&|\|\|", r"\bcheck\b", r"\bunique\b", r"\bnot\s+null\b", r"\bdefault\b", r"\bconstraint\b",
)


def has_logic(text: Column) -> Column:
    """Whether a text has a validation term or a sign of branching, comparison or policy."""
    return F.coalesce(text.rlike(rf"(?iU)\b(?:{'|'.join(VALIDATION_TERMS)})\b") | text.rlike("(?iU)" + "|".join(LOGIC)), F.lit(False))


def should_embed(text: Column, least: int) -> Column:
    """Long enough, or with business logic, or no bound at all."""
    return F.lit(least <= 0) | (token_estimate(text) >= least) | has_logic(text)


def identifier(name: Column) -> Column:
    """The last dotted part of a quoted SQL name, unquoted."""
    return F.regexp_replace(F.element_at(F.split(name, r"\."), -1), r'^[\["`]+|[\]"`]+$', "")


CUT = "\x00"


def places(text: Column, pattern: str | Column) -> Column:
    """array of (start, end, match) of a pattern's matches, in code points; matches must not be empty. A text without any
    costs one test. Ends are running sums over blocks of matches, so that many matches in a text cost little more each."""
    wanted = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    hits = F.regexp_extract_all(text, wanted, F.lit(0))
    # split() compiles its pattern for each row, but not one of a single character
    gaps = F.when(F.contains(text, F.lit(CUT)), F.split(text, wanted, -1)).otherwise(F.split(F.regexp_replace(text, wanted, F.lit(CUT)), CUT, -1))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct((F.char_length(g) + F.char_length(h)).alias("step"), F.char_length(h).alias("long"), h.alias("match")))
    return F.when(F.rlike(text, wanted), _let(pairs, _placed)).otherwise(none)


def _let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(pairs: Column) -> Column:
    """Places of (step from the last match's end to this one's, length, match)."""
    block = 64
    total = lambda first, n: F.aggregate(F.slice(pairs, first, n), F.lit(0), lambda s, p: s + p["step"])
    sums = F.transform(F.sequence(F.lit(0), ((F.size(pairs) - 1) / block).cast("int")), lambda b: total(b * block + 1, F.lit(block)))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def one(before, p, i):
        b = (i / block).cast("int")
        end = F.get(before, b) + total(b * block + 1, i % block + 1)
        return F.struct((end - p["long"]).alias("start"), end.alias("end"), p["match"].alias("match"))

    return _let(before, lambda before: F.transform(pairs, lambda p, i: one(before, p, i)))
