"""Symbols with scopes, and calls, from source texts by pattern: what a definition encloses, its container and qualified name.

Strings and comments are blanked first, line by line places stay. In languages with braces all braces and semicolons of a
file are numbered by a running sum of depth: at one depth openings and closings alternate, so the next one at its depth closes a
brace. A definition's body is opened by the next of these signs after it; a semicolon means that it has none. In Python a
body ends before the next line that is not indented further.

Containers are the definitions around a definition, found by the range index; the one that is tightest is its container, and
all of them in order make its qualified name. Facts that patterns find have confidence 0.9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines
from ..tables import written
from .intervals import containing

_string = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
#: What is blanked before anything is looked for.
NOISE = {
    "python": rf'(?s:""".*?"""|\'\'\'.*?\'\'\')|{_string}|#[^\n]*',
    **dict.fromkeys(("java", "csharp"), rf"{_string}|//[^\n]*|(?s:/\*.*?\*/)"),
    **dict.fromkeys(("javascript", "typescript"), rf"{_string}|(?s:`(?:[^`\\]|\\.)*`)|//[^\n]*|(?s:/\*.*?\*/)"),
}
_modifiers = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|partial|synchronized|default|export|get|set|readonly)\s+)*"
_no_word = r"(?!(?:return|new|throw|else|await|yield|case|if|for|while|switch|catch|foreach|using|lock|function|do|try|in|is|as)\b)"
_type = rf"(?<=^|[{{}};])\s*(?:@\w+\s+)*{_modifiers}{_no_word}"
_parameters = r"\s*\((?:[^(){};])*\)\s*"
_typed_method = rf"{_type}[A-Za-z_][\w.]*(?:<[\w<>, .?\[\]]*>)?(?:\[\])*\s+{_no_word}([A-Za-z_]\w*){_parameters}(?:throws\s+[\w., ]+)?(?=[{{;]|=>|$)"
_script = (
    ("function_declaration", r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("), ("method_definition", rf"{_type}([A-Za-z_$][\w$]*){_parameters}(?::\s*[\w<>\[\]|., ]+?)?\s*(?=\{{)"),
    ("arrow_function", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^()]*\)\s*(?::\s*[\w<>\[\]|. ]+?)?\s*=>"),
)


def _types(*words: str) -> tuple:
    return tuple((f"{w}_declaration", rf"(?<![\w.]){w}\s+([A-Za-z_$][\w$]*)") for w in words)


#: Kinds of definitions with their pattern, whose first group is the name.
DEFINITIONS = {
    "java": (*_types("class", "interface", "enum", "record"), ("method_declaration", _typed_method)),
    "csharp": (*_types("class", "interface", "enum", "record", "struct"), ("method_declaration", _typed_method)),
    "javascript": (*_types("class"), *_script), "typescript": (*_types("class", "interface", "enum"), *_script),
    "python": (("class_definition", r"^\s*class\s+([A-Za-z_]\w*)"), ("function_definition", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)")),
}
CALL = r"\b(?:(new)\s+)?([A-Za-z_$][\w$]*)\s*\("
#: Words before a parenthesis that are no calls.
NO_CALLS = ("if", "for", "foreach", "while", "switch", "catch", "return", "function", "class", "def", "elif", "and", "or", "not", "in", "lambda", "lock", "using", "typeof", "sizeof", "super", "synchronized", "await", "except", "with", "assert", "print")


def blanked(text: Column, noise: str) -> Column:
    """The text without what matches, but for its line ends."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(noise), F.lit(0)), lambda h: F.regexp_replace(h, "[^\n]", ""))
    return F.array_join(F.zip_with(F.split(text, noise, -1), hits, lambda part, hit: F.concat(part, F.coalesce(hit, F.lit("")))), "")


def source_lines(files: DataFrame, key: str) -> DataFrame:
    """key, language, line, t: the lines of files (key, language, text) of known languages, strings and comments blanked."""
    text = F.lit(None).cast("string")
    for language, noise in NOISE.items():
        text = F.when(F.col("language") == language, blanked(F.col("text"), noise)).otherwise(text)
    rows = files.select(key, "language", text.alias("text")).filter("text IS NOT NULL")
    return rows.select(key, "language", F.posexplode(lines(F.col("text"))).alias("i", "t")).select(key, "language", (F.col("i") + 1).cast("long").alias("line"), "t")


def _named(kind: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))


def definitions(rows: DataFrame, key: str) -> DataFrame:
    """key, language, line, pos, name, kind of the definitions in rows (source_lines, which the caller writes once)."""
    hit = F.array().cast("array<struct<name:string,kind:string>>")
    for language, patterns in DEFINITIONS.items():
        each = [_named(kind, F.regexp_extract_all("t", F.lit(p), F.lit(1))) for kind, p in patterns]
        hit = F.when(F.col("language") == language, F.concat(*each)).otherwise(hit)
    rows = rows.select(key, "language", "line", "t", F.explode(hit).alias("d"))
    place = F.regexp_instr("t", F.concat(F.lit(r"(?<![\w$])\Q"), F.col("d.name"), F.lit(r"\E(?![\w$])")))
    return rows.select(key, "language", "line", place.cast("long").alias("pos"), "d.name", "d.kind").dropDuplicates([key, "line", "pos", "name"])


def _braced(rows: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """defs with end_line, by braces."""
    signs = F.regexp_extract_all("t", F.lit("[{};]"), F.lit(0))
    gaps = F.transform(F.split("t", "[{};]", -1), lambda g: F.char_length(g) + 1)
    at = F.transform(gaps, lambda g, i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + x))
    tokens = rows.filter("language != 'python'").select(key, "line", F.explode(F.zip_with(F.slice(at, 1, F.size(signs)), signs, lambda p, s: F.struct(p.cast("long").alias("pos"), s.alias("sign")))).alias("x")).select(key, "line", "x.pos", "x.sign")
    step = F.when(F.col("sign") == "{", 1).when(F.col("sign") == "}", -1).otherwise(0)
    order = Window.partitionBy(key).orderBy("line", "pos")
    tokens = tokens.withColumn("after", F.sum(step).over(order)).withColumn("depth", F.when(F.col("sign") == "{", F.col("after") - 1).otherwise(F.col("after")))
    # At one depth, openings and closings alternate.
    braces = tokens.filter("sign != ';'").withColumn("close", F.lead("line").over(Window.partitionBy(key, "depth").orderBy("line", "pos")))
    signs = braces.filter("sign = '{'").select(key, "line", "pos", F.struct(F.lit(True).alias("opens"), "close").alias("sign")).unionByName(tokens.filter("sign = ';'").select(key, "line", "pos", F.struct(F.lit(False).alias("opens"), F.col("line").alias("close")).alias("sign")))
    both = defs.withColumn("sign", F.lit(None).cast(signs.schema["sign"].dataType)).unionByName(signs, allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy(F.desc("line"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("body", F.last("sign", ignorenulls=True).over(back)).filter("name IS NOT NULL").select(*defs.columns, F.coalesce("body.close", "line").alias("end_line"))


def _indented(rows: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """defs with end_line, by indents."""
    full = rows.filter("language = 'python' AND trim(t) != ''").select(key, "line", (F.char_length("t") - F.char_length(F.ltrim(F.regexp_replace("t", "^[ \t]+", "")))).alias("indent"))
    defs = defs.join(full, [key, "line"])
    levels = defs.groupBy(key).agg(F.collect_set("indent").alias("levels"))  # as many as a file is deep
    ends = full.join(levels, key).select(key, "line", "indent", F.explode(F.filter("levels", lambda x: x >= F.col("indent"))).alias("level"))
    after = ends.select(key, "level", "line", F.lead("line").over(Window.partitionBy(key, "level").orderBy("line")).alias("next"), "indent").filter("indent = level")
    last = full.groupBy(key).agg(F.max("line").alias("last"))
    rows = defs.join(after.select(key, "line", "next"), [key, "line"]).join(last, key)
    # The body ends with the last line that is not blank before the next one that is not further in.
    shut = rows.select(*[c for c in defs.columns if c != "indent"], F.coalesce(F.col("next") - 1, F.col("last")).alias("bound"))
    seen = shut.select(key, F.col("bound").alias("line")).distinct().withColumn("full", F.lit(None).cast("long")).unionByName(full.select(key, "line", F.col("line").alias("full")))
    upto = seen.select(key, "line", F.max("full").over(Window.partitionBy(key).orderBy("line")).alias("end_line")).groupBy(key, "line").agg(F.max("end_line").alias("end_line")).withColumnRenamed("line", "bound")
    return shut.join(upto, [key, "bound"]).drop("bound")


def scoped_symbols(rows: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """symbol_id, key, language, name, qualified_name, kind, container_id, start_line, end_line, confidence of defs (definitions of
    rows, which the caller writes once). A definition without a body ends on its line."""
    ended = _braced(rows, defs.filter("language != 'python'"), key).unionByName(_indented(rows, defs.filter("language = 'python'"), key))
    symbols = written(ended).select(F.concat_ws(":", key, "line", "pos").alias("symbol_id"), key, "language", "name", "kind", F.col("line").alias("start_line"), "end_line", "pos")
    spans = symbols.select("symbol_id", key, "name", "pos", "start_line", "end_line")
    size = lambda x: F.col(f"{x}.end_line") - F.col(f"{x}.start_line")
    around = containing(spans, spans, key).filter((F.col("r.symbol_id") != F.col("s.symbol_id")) & ((size("s") > size("r")) | (F.col("s.start_line") < F.col("r.start_line")) | (F.col("s.pos") < F.col("r.pos"))))
    place = F.struct(F.col("s.start_line").alias("line"), F.col("s.pos").alias("pos"), F.col("s.name").alias("name"), F.col("s.symbol_id").alias("id"))
    chain = around.groupBy(F.col("r.symbol_id").alias("symbol_id")).agg(F.array_sort(F.collect_list(place)).alias("chain"))  # as long as the nesting is deep
    names = F.concat(F.transform(F.coalesce("chain", F.array().cast(chain.schema["chain"].dataType)), lambda x: x["name"]), F.array("name"))
    return symbols.join(chain, "symbol_id", "left").select("symbol_id", key, "language", "name", F.array_join(names, ".").alias("qualified_name"), "kind", F.element_at("chain", -1)["id"].alias("container_id"), "start_line", "end_line", F.lit(0.9).alias("confidence"))


def calls(rows: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """ref_id, key, language, name, kind (method_invocation or object_creation), evidence, start_line, end_line of the calls in rows;
    a name that a line defines (defs) is no call on that line."""
    hits = F.arrays_zip(F.regexp_extract_all("t", F.lit(CALL), F.lit(1)).alias("new"), F.regexp_extract_all("t", F.lit(CALL), F.lit(2)).alias("name"))
    found = rows.select(key, "language", "line", "t", F.posexplode(hits).alias("i", "c")).filter(~F.col("c.name").isin(*NO_CALLS)).select(key, "language", "line", "i", "t", "c.name", F.when(F.col("c.new") == "new", "object_creation").otherwise("method_invocation").alias("kind"))
    found = found.join(defs.select(key, "line", "name"), [key, "line", "name"], "left_anti")
    return found.select(F.concat_ws(":", key, "line", "i").alias("ref_id"), key, "language", "name", "kind", F.trim("t").alias("evidence"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
