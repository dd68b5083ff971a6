"""Dependency graph: references resolved by name to symbols, kinds of edges, one-hop reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import innermost


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (ref_id, name, language, path) with callee_id and confidence.

    One candidate (by name or qualified name): 0.85. Several: one of the same language, of the same file first, then by
    (path, start_line, symbol_id), at 0.70; none of the language 0.40, no candidate 0.30, both without a callee."""
    names = symbols.select("symbol_id", "path", "language", "start_line", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    # Of a name's candidates, however many, three rows can be the answer; they are found once a name, not once a reference.
    every = names.groupBy("name").agg(F.count("symbol_id").alias("n"), F.min("symbol_id").alias("any"))
    own = names.groupBy("name", "language").agg(F.min(F.struct("path", "start_line", "symbol_id")).alias("own"))
    near = names.groupBy("name", "language", "path").agg(F.min(F.struct("start_line", "symbol_id")).alias("near"))
    found = refs.select("ref_id", "name", "language", "path").join(every, "name", "left").join(own, ["name", "language"], "left").join(near, ["name", "language", "path"], "left")
    n, best = F.coalesce("n", F.lit(0)), F.coalesce("near.symbol_id", "own.symbol_id")
    callee = F.when(n == 1, F.col("any")).when(n > 1, best)
    sure = F.when(n == 0, 0.30).when(n == 1, 0.85).when(best.isNotNull(), 0.70).otherwise(0.40)
    return found.select("ref_id", callee.alias("callee_id"), sure.cast("double").alias("confidence"), n.alias("candidates"))


# Kinds of references that are kinds of edges, those of XML files, and words by language.
SAME_KIND = ("implements", "foreign_key", "associates", "has_field_of_type", "accepts_dto", "returns_dto")
XML_KINDS = {
    "hibernate_table": "uses_table", "hibernate_column": "uses_column", "hibernate_entity": "maps_to", "hibernate_association": "associates", "spring_bean_class": "instantiates",
    "webflow_evaluate": "calls", "webflow_subflow": "invokes_subflow", "webflow_transition": "transitions_to",
}
TABLE_WORDS = ("FROM", "JOIN", "UPDATE", "INTO")
CALL_WORDS = ("call", "invocation", "method_invocation", "object_creation")


def _has(text: Column, *words: str) -> Column:
    """Whether any of the words is in the text."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def edge_kind(ref_kind: Column, name: Column, evidence: Column, language: Column, callee_kind: Column) -> Column:
    """The kind of an edge, by the first rule that holds: rules are (of a language or all, test, kind)."""
    kind, said = F.lower(F.coalesce(ref_kind, F.lit(""))), F.upper(F.coalesce(evidence, F.lit("")))
    either = kind == "inherits_or_implements"
    interface = F.coalesce(callee_kind == "interface_declaration", name.rlike("^I[A-Z]"))
    xml = F.create_map(*(F.lit(x) for kv in XML_KINDS.items() for x in kv))
    rules = [
        (None, either & interface, F.lit("implements")), (None, either | (kind == "extends"), F.lit("inherits")), (None, kind.isin(*SAME_KIND), kind),
        ("xml", F.lit(True), F.coalesce(xml[kind], F.lit("references"))),
        ("cobol", _has(said, "EXEC SQL"), F.lit("executes_sql")), ("cobol", _has(said, "EXEC CICS"), F.lit("executes_cics")), ("cobol", _has(said, "PERFORM") | _has(kind, "perform"), F.lit("performs")), ("cobol", _has(said, "CALL"), F.lit("calls")),
        ("cobol", _has(kind, "exec") & _has(kind, "sql"), F.lit("executes_sql")), ("cobol", _has(kind, "exec") & _has(kind, "cics"), F.lit("executes_cics")), ("cobol", _has(kind, "call"), F.lit("calls")),
        ("sql", _has(kind, "exec", "call"), F.lit("calls")), ("sql", _has(said, *TABLE_WORDS) | _has(kind, "table_reference", "object_reference"), F.lit("uses_table")),
        (None, _has(kind, "import", "using"), F.lit("imports")), (None, _has(kind, *CALL_WORDS), F.lit("calls")),
    ]
    out = F.lit("references")
    for of, test, to in reversed(rules):
        out = F.when(test if of is None else F.coalesce(language == of, F.lit(False)) & test, to).otherwise(out)
    return out


def edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, caller_id, callee_id, edge_kind, confidence of refs (ref_id, name, kind, evidence, language, path, start_line,
    end_line, enclosing_id) among symbols (symbol_id, name, qualified_name, kind, path, language, start_line, end_line).

    The caller is the enclosing symbol if the reference names it, else the innermost symbol around its lines."""
    found = resolve(refs, symbols)
    around = innermost(refs.select("ref_id", "path", "start_line", "end_line"), symbols.select("symbol_id", "path", "start_line", "end_line"), "path", "ref_id", "symbol_id")
    kinds = symbols.select(F.col("symbol_id").alias("callee_id"), F.col("kind").alias("callee_kind"))
    rows = refs.join(found, "ref_id").join(around.select("ref_id", F.col("symbol_id").alias("around_id")), "ref_id").join(kinds, "callee_id", "left")
    how = edge_kind(F.col("kind"), F.col("name"), F.col("evidence"), F.col("language"), F.col("callee_kind"))
    return rows.select("ref_id", F.coalesce("enclosing_id", "around_id").alias("caller_id"), "callee_id", how.alias("edge_kind"), "confidence")


def callers(edges: DataFrame, target_id, name: str, kinds: list[str] | None = None) -> DataFrame:
    """Edges to a symbol; if there are none, unresolved edges to its name. fallback says which."""
    rows = edges if kinds is None else edges.filter(F.col("edge_kind").isin(kinds))
    exact = rows.filter(F.col("callee_id") == target_id).withColumn("fallback", F.lit(False))
    by_name = rows.filter(F.col("callee_id").isNull() & (F.col("callee_name") == name)).withColumn("fallback", F.lit(True))
    some = exact.limit(1).select(F.lit(1).alias("one"))
    return exact.unionByName(by_name.join(F.broadcast(some), F.lit(True), "left_anti"))
