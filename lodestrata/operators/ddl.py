"""SQL definitions: tables, columns and keys of CREATE TABLE and ALTER TABLE.

A small helper cuts each text into the entries of its statements, outside comments and literals, by depth of parentheses;
what an entry says is read by column functions. A CREATE TABLE whose list is never closed is left out. Null or empty texts
and texts without such statements give no rows; repeated rows give repeated rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED = r'"[^"]*"|\[[^\]]*\]|`[^`]*`'
BARE = r"[#@]{0,2}[^\W\d][\w$#@]*"
IDENT = rf"(?:{QUOTED}|{BARE})"
NAME = rf"{IDENT}(?:\s*\.\s*{IDENT})*"

_hidden = re.compile(rf"({QUOTED})|--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)", re.S)
_head = re.compile(
    rf"\bCREATE\s+(?:(?:GLOBAL|LOCAL)\s+)?(?P<temp>TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<made>{NAME})\s*\("
    rf"|\bALTER\s+TABLE\s+(?:IF\s+EXISTS\s+|ONLY\s+)*(?P<altered>{NAME})\s+(?:WITH\s+(?:NO)?CHECK\s+)?(?=ADD\b)",
    re.I,
)
_token = re.compile(rf"{QUOTED}|[(),;]|\n\s*GO\b", re.I)


def masked(text: str) -> str:
    """The text with comments and literals blank, of the same length and lines; quoted names stay."""
    return _hidden.sub(lambda m: m[0] if m[1] else re.sub(r"[^\n]", " ", m[0]), text)


def _closed(text: str) -> set[int]:
    """Where parentheses open that are closed later."""
    out, opened = set(), []
    for t in _token.finditer(text):
        if t[0] == "(":
            opened.append(t.start())
        elif t[0] == ")" and opened:
            out.add(opened.pop())
    return out


def entries(ddl: str | None) -> list[tuple[int, str, bool, bool, str, int]]:
    """(statement, table as written, temporary, altered, entry, line) of what stands between commas outside parentheses, in
    the list of a CREATE TABLE or after an ALTER TABLE."""
    text, out, done, line, counted = masked(ddl or ""), [], 0, 1, 0
    heads = list(_head.finditer(text))
    closed = _closed(text) if heads else set()
    for n, m in enumerate(heads):
        made, begin, depth, parts = m["made"] is not None, m.end(), 0, []
        if m.start() < done or (made and m.end() - 1 not in closed):
            continue
        until = len(text) if made or n + 1 == len(heads) else heads[n + 1].start()
        for t in _token.finditer(text, m.end(), until):
            if t[0] == "(":
                depth += 1
            elif t[0] == ")":
                depth -= 1
            elif t[0] == "," and depth == 0:
                parts.append((begin, t.start()))
                begin = t.end()
            if depth < 0 or (not made and depth == 0 and (t[0] == ";" or t[0][0] == "\n")):
                parts.append((begin, t.start()))
                done = t.end()
                break
        else:
            parts.append((begin, until))
            done = until
        for a, b in parts:
            if entry := text[a:b].strip():
                at = a + len(text[a:b]) - len(text[a:b].lstrip())
                line, counted = line + text.count("\n", counted, at), at
                out.append((n, m["made"] or m["altered"], bool(m["temp"]), not made, entry, line))
    return out


def _plain(name: Column) -> Column:
    """The last part of a name, unquoted."""
    return F.regexp_replace(F.regexp_extract(name, rf"(?U)({IDENT})\s*$", 1), r'^[\["`]|[\]"`]$', "")


def _names(listed: Column) -> Column:
    return F.transform(F.regexp_extract_all(listed, F.lit("(?U)" + IDENT), F.lit(0)), lambda x: _plain(x))


CONSTRAINT = r"(?i)^(?:CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK|KEY|INDEX|EXCLUDE|PERIOD|WITH|LIKE)\b"


def sql_entries(files: DataFrame, key: str, ddl: str) -> DataFrame:
    """key, statement, table_name, is_temp, altered, entry, line; temporary by TEMP, TEMPORARY or a name that begins with
    # or @, which stays part of the name."""
    import pandas as pd

    from ..shipping import ship

    ship(files.sparkSession)
    names = ["statement", "written", "temp", "altered", "entry", "line"]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(k, *x) for k, t in zip(b["k"], b["t"], strict=True) for x in entries(t)], columns=["k", *names])

    kind = files.schema[key].dataType.simpleString()
    rows = files.select(F.col(key).alias("k"), F.col(ddl).alias("t")).mapInPandas(run, f"k {kind}, statement long, written string, temp boolean, altered boolean, entry string, line long")
    rows = rows.withColumn("table_name", _plain(F.col("written")))
    temp = F.col("temp") | F.col("table_name").rlike("^[#@]")
    return rows.select(F.col("k").alias(key), "statement", "table_name", temp.alias("is_temp"), "altered", "entry", "line")


def _defined(rows: DataFrame) -> DataFrame:
    """Entries that define a column: of a CREATE TABLE, or added by an ALTER TABLE."""
    entry = F.when(F.col("altered"), F.regexp_replace("entry", r"(?i)^ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?", "")).otherwise(F.col("entry"))
    added = ~F.col("altered") | F.col("entry").rlike(r"(?i)^ADD\b")
    return rows.filter(added).withColumn("entry", entry).filter(~F.col("entry").rlike(CONSTRAINT) & F.col("entry").rlike(rf"(?U)^{IDENT}\s+{IDENT}"))


def _column(rows: DataFrame, key: str) -> DataFrame:
    head = rf"(?U)^({IDENT})\s+({NAME})(?:\s+((?i:PRECISION|VARYING))\b)?\s*(\([^)]*\))?"
    part = lambda i: F.regexp_extract("entry", head, i)
    second = F.when(part(3) != "", F.concat(F.lit(" "), part(3))).otherwise("")
    said = F.regexp_replace("entry", QUOTED, " ")
    refers = F.nullif(_plain(F.regexp_extract("entry", rf"(?iU)\bREFERENCES\s+({NAME})", 1)), F.lit(""))
    return _defined(rows).select(
        key, "statement", "table_name", "is_temp", _plain(part(1)).alias("column_name"), F.concat(_plain(part(2)), second, part(4)).alias("data_type"),
        said.rlike(r"(?i)\bNOT\s+NULL\b").alias("not_null"), said.rlike(r"(?i)\bPRIMARY\s+KEY\b").alias("is_primary"), said.rlike(r"(?i)\bUNIQUE\b").alias("is_unique"), refers.alias("refers_to"), "line",
    )


def sql_columns(files: DataFrame, key: str, ddl: str) -> DataFrame:
    """key, table_name, is_temp, column_name, data_type, not_null, is_primary, is_unique, refers_to, line of columns; keys are
    those that stand with the column itself (sql_keys has all)."""
    return _column(sql_entries(files, key, ddl), key).drop("statement")


def sql_keys(files: DataFrame, key: str, ddl: str) -> DataFrame:
    """key, table_name, kind (primary, unique, foreign), columns, refers_to, refers_columns, line of keys, with a column, in a
    table's list or added by ALTER TABLE."""
    rows = sql_entries(files, key, ddl)
    columns = _column(rows, key)
    own = F.array(*(F.when(test, F.lit(kind)) for kind, test in (("primary", F.col("is_primary")), ("unique", F.col("is_unique")), ("foreign", F.col("refers_to").isNotNull()))))
    kind = F.explode(F.array_compact(own))
    refers = lambda kind: F.when(F.col("kind") == "foreign", kind)
    with_column = columns.select(key, "table_name", kind.alias("kind"), F.array("column_name").alias("columns"), "refers_to", F.lit(None).cast("array<string>").alias("refers_columns"), "line").withColumn("refers_to", refers(F.col("refers_to")))
    # A list in parentheses follows the kind, perhaps after a name, or CLUSTERED and the like.
    found = rf"(?iU)^(?:ADD\s+)?(?:CONSTRAINT\s+{NAME}\s+)?(PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY)(?:\s+(?:KEY|INDEX))?(?:\s+{IDENT})?\s*\(([^)]*)\)(?:\s*REFERENCES\s+({NAME})\s*(?:\(([^)]*)\))?)?"
    part = lambda i: F.regexp_extract("entry", found, i)
    # ASC and DESC after a name are no names.
    listed = lambda i: _names(F.regexp_replace(part(i), r"(?i)\s+(?:ASC|DESC)\b", ""))
    alone = rows.filter(F.col("entry").rlike(found)).select(
        key, "table_name", F.lower(F.regexp_extract(part(1), r"^\w+", 0)).alias("kind"), listed(2).alias("columns"),
        F.nullif(_plain(part(3)), F.lit("")).alias("refers_to"), F.when(part(4) != "", listed(4)).alias("refers_columns"), "line",
    )
    return with_column.unionByName(alone)
