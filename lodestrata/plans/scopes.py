"""Scoped symbols and calls of files that nest classes and functions, in five languages, made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import scopes as C
from ..tables import written
from .catalog import query, table

#: Files with braces in strings and comments; %s is the number of a part.
NESTED = {
    "java": 'public class C%s {\n  // class Fake { }\n  String s = "}{";\n  class Inner {\n    int twice(int x) { return add(x, x); }\n  }\n  void run() {\n    Inner i = new Inner();\n    i.twice(2);\n  }\n}\n',
    "csharp": "namespace N {\n  public class C%s\n  {\n    /* { \n } */\n    public int Total(int a)\n    {\n      if (a > 0) { return Sum(a); }\n      return 0;\n    }\n    abstract int Open(string s);\n  }\n}\n",
    "typescript": "export class C%s {\n  load(id: string): void {\n    const pick = (x: number) => {\n      return fetch(`}${x}`);\n    };\n    pick(1);\n  }\n}\ninterface Shape { area(): number; }\n",
    "javascript": "function outer%s(a) {\n  function inner(b) { return send(b); }\n  return inner(a);\n}\nclass K {\n  go() {\n    outer(1);\n  }\n}\n",
    "python": "class C%s:\n    '''class Fake:\n    def no(self): pass\n    '''\n    def run(self):\n        def step(x):\n            return add(x)\n\n        return step(1)  # call(me)\n\n    class Inner:\n        def last(self): self.run()\n",
}
#: Language, qualified name, kind, first and last line, the container's name; lines count from the first that is not padding.
_nested = [
    ("java", "C%", "class_declaration", 1, 11, None), ("java", "C%.Inner", "class_declaration", 4, 6, "C%"), ("java", "C%.Inner.twice", "method_declaration", 5, 5, "Inner"), ("java", "C%.run", "method_declaration", 7, 10, "C%"),
    ("csharp", "C%", "class_declaration", 2, 12, None), ("csharp", "C%.Total", "method_declaration", 6, 10, "C%"), ("csharp", "C%.Open", "method_declaration", 11, 11, "C%"),
    ("typescript", "C%", "class_declaration", 1, 8, None), ("typescript", "C%.load", "method_definition", 2, 7, "C%"), ("typescript", "C%.load.pick", "arrow_function", 3, 5, "load"), ("typescript", "Shape", "interface_declaration", 9, 9, None),
    ("javascript", "outer%", "function_declaration", 1, 4, None), ("javascript", "outer%.inner", "function_declaration", 2, 2, "outer%"), ("javascript", "K", "class_declaration", 5, 9, None), ("javascript", "K.go", "method_definition", 6, 8, "K"),
    ("python", "C%", "class_definition", 1, 12, None), ("python", "C%.run", "function_definition", 5, 9, "C%"), ("python", "C%.run.step", "function_definition", 6, 7, "run"), ("python", "C%.Inner", "class_definition", 11, 12, "C%"), ("python", "C%.Inner.last", "function_definition", 12, 12, "Inner"),
]
#: Language, line, name, the caller's and the callee's qualified name.
_called = [
    ("java", 5, "add", "C%.Inner.twice", None), ("java", 8, "Inner", "C%.run", "C%.Inner"), ("java", 9, "twice", "C%.run", "C%.Inner.twice"), ("csharp", 8, "Sum", "C%.Total", None),
    ("typescript", 4, "fetch", "C%.load.pick", None), ("typescript", 6, "pick", "C%.load", "C%.load.pick"), ("typescript", 9, "area", "Shape", None),
    ("javascript", 2, "send", "outer%.inner", None), ("javascript", 3, "inner", "outer%", "outer%.inner"), ("javascript", 7, "outer", "K.go", None),
    ("python", 7, "add", "C%.run.step", None), ("python", 9, "step", "C%.run", "C%.run.step"), ("python", 12, "run", "C%.Inner.last", "C%.run"),
]


def _values(rows) -> str:
    told = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return "VALUES " + ", ".join("(" + ", ".join(map(told, r)) + ")" for r in rows)


_files = "f AS (SELECT p_partkey, p_size % 4 AS pad, ['java', 'csharp', 'typescript', 'javascript', 'python'][p_partkey % 5 + 1] AS language FROM part)"
_name = "replace({}, '%', p_partkey::VARCHAR) AS {}"


def _nested_files(spark, d):
    """A file a part, with up to three empty lines in front."""
    k, text = F.col("p_partkey"), F.lit(None).cast("string")
    language = F.get(F.array(*map(F.lit, NESTED)), (k % 5).cast("int"))
    for name, body in NESTED.items():
        before, after = body.split("%s", 1)
        text = F.when(language == name, F.concat(F.lit(before), k.cast("string"), F.lit(after))).otherwise(text)
    return table(spark, d, "part").select("p_partkey", language.alias("language"), F.concat(F.repeat(F.lit("\n"), (F.col("p_size") % 4).cast("int")), text).alias("text"))


def _scoped(spark, d):
    """Symbols and calls; lines, definitions and symbols are written once."""
    rows = written(C.source_lines(_nested_files(spark, d), "p_partkey"))
    defs = written(C.definitions(rows, "p_partkey"))
    return written(C.scoped_symbols(rows, defs, "p_partkey")), C.calls(rows, defs, "p_partkey")


@query(f"WITH {_files}, v(language, q, kind, a, b, c) AS ({_values(_nested)}) SELECT p_partkey, language, {_name.format('q', 'qualified_name')}, kind, (a + pad)::BIGINT AS start_line, (b + pad)::BIGINT AS end_line, {_name.format('c', 'container')} FROM f JOIN v USING (language)")
def ex1_scoped_symbols(spark, d):
    found = _scoped(spark, d)[0]
    outer = found.select(F.col("symbol_id").alias("container_id"), F.col("name").alias("container"))
    return found.join(outer, "container_id", "left").select("p_partkey", "language", "qualified_name", "kind", "start_line", "end_line", "container")


@query(f"WITH {_files}, v(language, line, name, c, e) AS ({_values(_called)}) SELECT p_partkey, (line + pad)::BIGINT AS line, name, {_name.format('c', 'caller')}, {_name.format('e', 'callee')}, 'calls' AS edge_kind FROM f JOIN v USING (language)")
def ex2_call_edges(spark, d):
    """Calls in files that nest, as edges between scoped symbols; names are looked up within each file."""
    symbols, found = _scoped(spark, d)
    own = lambda name: F.concat_ws(" ", "p_partkey", name)
    known = symbols.select("symbol_id", own("name").alias("name"), own("qualified_name").alias("qualified_name"), "kind", F.col("p_partkey").alias("path"), "language", "start_line", "end_line")
    refs = found.select("ref_id", F.col("name").alias("word"), own("name").alias("name"), "kind", "evidence", "language", F.col("p_partkey").alias("path"), "start_line", "end_line", F.lit(None).cast("string").alias("enclosing_id"))
    edges = G.edges(refs.drop("word"), known).join(refs.select("ref_id", "word", F.col("path").alias("p_partkey"), F.col("start_line").alias("line")), "ref_id")
    named = lambda side: symbols.select(F.col("symbol_id").alias(f"{side}_id"), F.col("qualified_name").alias(side))
    return edges.join(named("caller"), "caller_id", "left").join(named("callee"), "callee_id", "left").select("p_partkey", "line", F.col("word").alias("name"), "caller", "callee", "edge_kind")
