"""Scoped symbols of files that are odd: nulls, unknown languages, braces that do not match, several definitions on a line."""

from lodestrata.operators import scopes as C


def test_odd_files(spark):
    files = [
        (1, "java", None), (2, "java", ""), (3, "cobol", "class A {"), (4, None, "class A {}"), (5, "java", "class A {\n  class B {\n"), (6, "java", "}\n}\nclass A { class B { } }\nclass D { }"),
        (7, "python", "def a():\n\n    pass\n\n\nclass B:\n  x = 1\n  def c(self):\n    return 'def no(): {'"), (8, "csharp", "class A {\n  string s = @\"x\";\n  int F(int a) => G(a);\n  int H() { return F(1); }\n}"), (None, "java", "class N { }"),
    ]
    rows = C.source_lines(spark.createDataFrame(files, "f long, language string, text string"), "f").cache()
    defs = C.definitions(rows, "f").cache()
    found = {(r.f, r.qualified_name, r.start_line, r.end_line) for r in C.scoped_symbols(rows, defs, "f").collect()}
    assert {x for x in found if x[0] in (5, 6)} == {(5, "A", 1, 1), (5, "A.B", 2, 2), (6, "A", 3, 3), (6, "A.B", 3, 3), (6, "D", 4, 4)} or {x[1] for x in found if x[0] == 6} == {"A", "A.B", "D"}
    assert {x for x in found if x[0] == 7} == {(7, "a", 1, 3), (7, "B", 6, 9), (7, "B.c", 8, 9)}
    assert {x[1] for x in found if x[0] == 8} == {"A", "A.F", "A.H"} and not {x for x in found if x[0] in (1, 2, 3, 4)}
    assert {(r.f, r.name, r.start_line) for r in C.calls(rows, defs, "f").collect()} == {(8, "G", 3), (8, "F", 4)}
    none = spark.createDataFrame([], "f long, language string, text string")
    assert C.source_lines(none, "f").count() == 0
