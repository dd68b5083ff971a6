"""Extraction from code by pattern: definitions with containers, inheritance and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

# Definition patterns by language, and types that are no symbols.
DEFINITIONS = {
    "python": r"^\s*(?:class|def)\s+([A-Za-z_]\w*)", "java": r"^\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum)\s+([A-Za-z_]\w*)", "csharp": r"^\s*(?:public|private|internal|static|sealed|abstract|partial|\s)*(?:class|interface|struct|enum)\s+([A-Za-z_]\w*)",
    "sql": r"(?i)^\s*create\s+(?:table|view|procedure)\s+([\w.\[\]\"]+)", "cobol": r"^\s*([A-Z0-9-]+)\.\s*$",
}
PRIMITIVES = {
    "csharp": ("int", "uint", "long", "ulong", "short", "ushort", "byte", "sbyte", "nint", "nuint", "bool", "char", "string", "object", "void", "decimal", "double", "float", "dynamic", "var", "Task", "ValueTask", "DateTime", "DateTimeOffset", "TimeSpan", "Guid"),
    "java": ("int", "long", "short", "byte", "char", "boolean", "float", "double", "void", "String", "Object", "Integer", "Long", "Short", "Byte", "Character", "Boolean", "Float", "Double", "Void", "CharSequence"),
    "python": ("int", "str", "float", "bool", "bytes", "bytearray", "complex", "object", "None", "list", "dict", "set", "tuple", "frozenset", "type", "Any", "Optional", "Union", "List", "Dict", "Set", "Tuple", "Sequence", "Mapping", "Iterable", "Callable"),
    "typescript": ("string", "number", "boolean", "any", "void", "unknown", "never", "null", "undefined", "object", "symbol", "bigint", "this", "Promise", "Array"),
    "javascript": ("string", "number", "boolean", "any", "void", "object", "undefined", "null"),
}
#: Containers whose arguments are the types meant.
WRAPPERS = ("List", "Map", "Set", "Optional", "Collection", "Task", "IEnumerable", "IList", "ICollection", "Promise", "Array")


def definitions(files: DataFrame, key: str) -> DataFrame:
    """key, language, name, line of definitions in rows (key, language, text)."""
    rows = files.select(key, "language", F.posexplode(lines(F.col("text"))).alias("i", "t"))
    name = F.lit("")
    for lang, p in DEFINITIONS.items():
        name = F.when(F.col("language") == lang, F.regexp_extract("t", p, 1)).otherwise(name)
    return rows.select(key, "language", name.alias("name"), (F.col("i") + 1).cast("long").alias("line")).filter("name != ''")


def inheritance(files: DataFrame, key: str) -> DataFrame:
    """key, line, child, parent, kind: extends and implements clauses; after a colon or in Python it may be either."""
    rows = files.select(key, F.posexplode(lines(F.col("text"))).alias("i", "t")).filter(F.col("t").rlike(r"\b(class|interface)\s"))
    child = F.regexp_extract("t", r"\b(?:class|interface)\s+([A-Za-z_]\w*)", 1)
    parts = F.array(
        F.struct(F.lit("extends").alias("kind"), F.regexp_extract("t", r"\bextends\s+([\w.<>, ]+?)(?:\s+implements\b|\s*\{|$)", 1).alias("p")),
        F.struct(F.lit("implements").alias("kind"), F.regexp_extract("t", r"\bimplements\s+([\w.<>, ]+?)(?:\s*\{|$)", 1).alias("p")),
        F.struct(F.lit("inherits_or_implements").alias("kind"), F.regexp_extract("t", r"\bclass\s+[A-Za-z_]\w*\s*(?::\s*([\w.<>, ]+?)\s*(?:\{|$)|\(([\w., ]+)\)\s*:)", 1).alias("p")),
        F.struct(F.lit("inherits_or_implements").alias("kind"), F.regexp_extract("t", r"\bclass\s+[A-Za-z_]\w*\s*\(([\w., ]+)\)\s*:", 1).alias("p")),
    )
    found = rows.select(key, (F.col("i") + 1).cast("long").alias("line"), child.alias("child"), F.explode(parts).alias("s")).filter("s.p != ''")
    return found.select(key, "line", "child", "s.kind", F.explode(F.split(F.regexp_replace("s.p", "<[^>]*>", ""), r"\s*,\s*")).alias("parent")).filter("parent != ''")


def type_refs(files: DataFrame, key: str) -> DataFrame:
    """key, line, predicate, type of rows (key, language, text): has_field_of_type for typed fields, accepts_dto for
    parameters, returns_dto for what a method returns. Generics are unwrapped, containers and the language's own types left out."""
    rows = files.select(key, "language", F.posexplode(lines(F.col("text"))).alias("i", "t"))
    typed = r"((?:[A-Za-z_][\w.]*)(?:<[\w<>, .\[\]]+>)?)(?:\[\])?"
    method = F.regexp_extract("t", rf"^\s*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|synchronized)\s+)*{typed}\s+[A-Za-z_]\w*\s*\(([^)]*)\)\s*(?:throws\b[^{{;]*)?[{{;]", 1)
    inside = F.regexp_extract("t", r"\b[A-Za-z_]\w*\s*\(([^)]*)\)\s*(?:throws\b[^{;]*)?[{;]", 1)
    is_method = (method != "") & ~method.isin("new", "return", "throw", "else")
    parameters = F.regexp_extract_all(inside, F.lit(rf"(?:^|,)\s*(?:final\s+|@\w+\s+|\[\w+\]\s*)*{typed}\s+[A-Za-z_]\w*"), F.lit(1))
    field = F.regexp_extract("t", rf"^\s*(?:(?:public|private|protected|internal|static|final|readonly|volatile|transient)\s+)*{typed}\s+[A-Za-z_]\w*\s*(?:[;=]|\{{\s*get)", 1)
    told = lambda p, names: F.transform(names, lambda x: F.struct(F.lit(p).alias("predicate"), x.alias("raw")))
    found = F.when(is_method, F.concat(told("returns_dto", F.array(method)), told("accepts_dto", parameters))).when((field != "") & ~field.isin("return", "throw", "new", "package", "import", "using"), told("has_field_of_type", F.array(field)))
    return _own_types(rows.select(key, "language", (F.col("i") + 1).cast("long").alias("line"), F.explode(found).alias("f")), key)


def _own_types(rows: DataFrame, key: str) -> DataFrame:
    """key, line, predicate, type of rows with f (predicate, raw): the names in raw that are types of the program's own."""
    names = F.explode(F.filter(F.split("f.raw", r"[<>,\s\[\]]+"), lambda x: x.rlike("^[A-Z]") & ~x.isin(*WRAPPERS)))
    own = F.create_map(*(x for k, v in PRIMITIVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = rows.select(key, "language", "line", "f.predicate", names.alias("type"))
    return rows.filter(~F.coalesce(F.array_contains(own[F.col("language")], F.col("type")), F.lit(False))).drop("language")


#: What may stand before a name in TypeScript.
_modifiers = r"(?:(?:export|default|public|private|protected|static|async|readonly|abstract|override|declare|function|get|set)\s+)*"
#: Languages with types after names: patterns of a function (parameters, result), a parameter and a field.
ANNOTATED = {
    "python": (r"^\s*(?:async\s+)?def\s+\w+\s*\((.*)\)\s*(?:->\s*([^:]+?))?\s*:", r"(?:^|,)\s*\*{0,2}\w+\s*:\s*((?:[^,=\[\]]|\[[^\]]*\])+)", r"^\s*(?:self\.)?\w+\s*:\s*([A-Za-z_][\w.|\[\], ]*?)\s*(?:=[^=].*|#.*)?$"),
    "typescript": (rf"^\s*{_modifiers}[\w$]+\s*(?:<[^>]*>)?\(([^()]*)\)\s*(?::\s*([^{{;=]+?))?\s*(?:\{{|;|=>|$)", r"(?:^|,)\s*(?:@\w+\(?\)?\s+)?(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?[\w$]+\??\s*:\s*((?:[^,=<>]|<[^>]*>)+)", rf"^\s*{_modifiers}[\w$]+[?!]?\s*:\s*([A-Za-z_][^=;(){{]*?)\s*(?:=.*)?;\s*(?://.*)?$"),
}
ANNOTATED["javascript"] = ANNOTATED["typescript"]


def annotated_type_refs(files: DataFrame, key: str) -> DataFrame:
    """As type_refs, for languages that write types after names; functions and fields of one line."""
    rows = files.select(key, "language", F.posexplode(lines(F.col("text"))).alias("i", "t"))
    told = lambda p, names: F.transform(F.filter(names, lambda x: x != ""), lambda x: F.struct(F.lit(p).alias("predicate"), plain(x).alias("raw")))
    plain = lambda x: F.regexp_replace(x, r"[A-Za-z_]\w*\.|[|&]", " ")  # noqa: E731  packages, and signs between types
    found = F.lit(None)
    for language, (function, parameter, field) in ANNOTATED.items():
        part = lambda p, i: F.regexp_extract("t", p, i)
        in_function = F.concat(told("returns_dto", F.array(part(function, 2))), told("accepts_dto", F.regexp_extract_all(part(function, 1), F.lit(parameter), F.lit(1))))
        of_language = F.when(F.col("t").rlike(function), in_function).otherwise(told("has_field_of_type", F.array(part(field, 1))))
        found = F.when(F.col("language") == language, of_language).otherwise(found)
    return _own_types(rows.select(key, "language", (F.col("i") + 1).cast("long").alias("line"), F.explode(found).alias("f")), key)


def thrown(files: DataFrame, key: str) -> DataFrame:
    """key, line, type of what methods declare to throw (Java), names without their packages; a clause of one line."""
    rows = files.filter("language = 'java'").select(key, F.posexplode(lines(F.col("text"))).alias("i", "t"))
    clause = F.regexp_extract("t", r"\)\s*throws\s+([\w.$, ]+)", 1)
    rows = rows.filter(F.col("t").contains("throws")).select(key, (F.col("i") + 1).cast("long").alias("line"), F.explode(F.split(clause, r"\s*,\s*")).alias("name"))
    return rows.select(key, "line", F.trim(F.substring_index("name", ".", -1)).alias("type")).filter("type != ''")
