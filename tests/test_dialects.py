"""SQL definitions, XML dialects, and places of many matches in a text."""

import re
import time

from pyspark.sql import functions as F

from lodestrata.functions.text import places
from lodestrata.operators import ddl, dialects, markup


def test_ddl_entries():
    cut = lambda t: [(e[1], e[3], e[4], e[5]) for e in ddl.entries(t)]
    assert cut("EXEC('CREATE TABLE a (b int)') -- CREATE TABLE c (d int)") == [] and cut(None) == [] and cut("") == []
    assert cut("create table a (b int,\n c dec(1,2), \"x)\" int)") == [("a", False, "b int", 1), ("a", False, "c dec(1,2)", 2), ("a", False, '"x)" int', 2)]
    assert cut("CREATE TABLE a (b int; CREATE TABLE c (d int)") == [("c", False, "d int", 1)]
    # An ALTER TABLE without an end stops where the next statement begins.
    assert cut("ALTER TABLE a ADD b int\nCREATE TABLE c (d int)") == [("a", True, "ADD b int", 1), ("c", False, "d int", 2)]
    assert [e[2] for e in ddl.entries("CREATE GLOBAL TEMPORARY TABLE a (b int); CREATE TABLE c (d int)")] == [True, False]


def test_ddl_is_linear_in_unclosed_statements():
    began = time.time()
    assert ddl.entries("CREATE TABLE a (b int,\n" * 100_000) == []
    assert len(ddl.entries("CREATE TABLE a (b int);\n" * 100_000)) == 100_000
    assert time.time() - began < 20


def test_keys(spark):
    sql = 'CREATE TABLE s.t (a INT, b INT UNIQUE, "c d" INT, PRIMARY KEY CLUSTERED (a ASC, "c d" DESC), UNIQUE KEY k (b), FOREIGN KEY (a, b) REFERENCES [x].[two] (c, [d e])); ALTER TABLE ONLY s.t ADD COLUMN z BIGINT NOT NULL REFERENCES o, ADD CONSTRAINT q UNIQUE (z);'
    frame = spark.createDataFrame([(1, sql, 0), (1, sql, 0), (2, None, 0)], "line_key long, t string, entry int")
    got = sorted((r.table_name, r.kind, tuple(r.columns), r.refers_to or "", tuple(r.refers_columns or ())) for r in ddl.sql_keys(frame, "line_key", "t").collect())
    want = [("t", "foreign", ("a", "b"), "two", ("c", "d e")), ("t", "foreign", ("z",), "o", ()), ("t", "primary", ("a", "c d"), "", ()), ("t", "unique", ("b",), "", ()), ("t", "unique", ("b",), "", ()), ("t", "unique", ("z",), "", ())]
    assert got == sorted(want * 2)
    assert [(r.column_name, r.not_null) for r in ddl.sql_columns(frame.limit(1), "line_key", "t").collect()] == [("a", False), ("b", False), ("c d", False), ("z", True)]


def test_xml_symbols_and_refs(spark):
    nested = "<hibernate-mapping>\n<class entity-name='a.B' table=' t '><subclass name='a.b.C'>\n<version name='v' column='V'/><many-to-one class='x.Y'/></subclass>\n<timestamp name='w'/></class><property name='loose' column='L'/><class/></hibernate-mapping>"
    beans = "<beans>\n<bean class='p.Q'><property ref='o'/></bean><bean name='n'/></beans>"
    files = [(1, nested), (2, beans), (3, "<flow><transition to='x'/></flow>"), (4, "<other/>"), (5, "<broken"), (6, None), (7, "")]
    rows = dialects.elements(spark.createDataFrame(files, "k long, text string"), "k")
    symbols = [(r.k, r.name, r.qualified_name, r.kind, r.line) for r in dialects.xml_symbols(rows, "k", F.lit("f")).collect()]
    assert sorted(symbols) == [
        (1, "<anonymous-class>", "<anonymous-class>", "hibernate_class_mapping", 4), (1, "B", "a.B", "hibernate_class_mapping", 2), (1, "C", "a.b.C", "hibernate_class_mapping", 2), (1, "v", "C.v", "hibernate_version", 3), (1, "w", "B.w", "hibernate_timestamp", 4),
        (2, "Q", "Q", "spring_bean", 2), (2, "n", "n", "spring_bean", 2), (3, "f", "f", "webflow_flow", 1), (4, "f", "f", "xml_document", 1),
    ]
    refs = sorted((r.k, r.name, r.kind, r.enclosing_id) for r in dialects.xml_refs(rows, "k", F.lit("f")).collect() if r.enclosing_id)
    assert refs == [
        (1, "B", "hibernate_entity", "xml:1:a.B:2"), (1, "C", "hibernate_entity", "xml:1:a.b.C:2"), (1, "V", "hibernate_column", "xml:1:a.b.C:2"), (1, "Y", "hibernate_association", "xml:1:a.b.C:2"), (1, "t", "hibernate_table", "xml:1:a.B:2"),
        (2, "Q", "spring_bean_class", "xml:2:Q:2"), (3, "x", "webflow_transition", "xml:3:f:1"),
    ]
    assert [r.name for r in dialects.xml_refs(rows, "k", F.lit("f")).filter("enclosing_id IS NULL").collect()] == ["L"]


def test_files_share_batches_of_elements(spark, monkeypatch):
    """one batch a file cost milliseconds each. Keys of other types, repeated rows, and files over several batches."""
    monkeypatch.setattr(dialects, "BATCH", 4)
    many = "<beans>" + "".join(f"<bean id='b{i}' class='m.C'/>" for i in range(10)) + "</beans>"
    files = [("a", many), (None, "<x/>"), ("b", "<broken"), ("c", None), ("d", "<x/>"), ("d", "<x/>")]
    got = dialects.elements(spark.createDataFrame(files, "k string, text string").coalesce(1), "k").collect()
    assert [(r.k, r.ord, r.attrs.get("id"), r.up_ord) for r in got] == [("a", 0, None, None), *(("a", i + 1, f"b{i}", None) for i in range(10)), (None, 0, None, None), ("d", 0, None, None), ("d", 0, None, None)]
    small = [(i, f"<hibernate-mapping><class name='E{i}' table='t'/></hibernate-mapping>") for i in range(20_000)]
    frame = spark.createDataFrame(small, "k long, text string").repartition(4)
    monkeypatch.undo()
    assert dialects.elements(frame, "k").count() == 40_000
    began = time.time()
    assert dialects.xml_facts(frame, "k").count() == 20_000
    assert time.time() - began < 10


def test_queries_on_xml_use_all_cores(spark):
    """the parts of one small file were parsed in one task."""
    from lodestrata.plans import dialects as plans

    cores = spark.sparkContext.defaultParallelism
    assert 2 * plans.ex8_xml_refs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > cores


def test_symbols_of_many_files(spark):
    """one batch a file cost milliseconds each; files are in one task here."""
    files = spark.range(20_000).selectExpr("id AS k", "concat('<flow><view-state id=\"s', id, '\"/></flow>') AS text").coalesce(1)
    began = time.time()
    found = dialects.xml_symbols(dialects.elements(files, "k"), "k", F.lit("f"))
    assert found.filter("kind = 'view_state' AND name = concat('s', k)").count() == 20_000 and time.time() - began < 20


def test_code_of_symbols_is_compiled(spark, capsys):
    """what Spark made of the columns was one method of 61,714 bytes, beyond the 8,000 that the JVM compiles."""
    from lodestrata.plans import dialects as plans

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the code of an adaptive plan is made while it runs
    try:
        plans.ex8_xml_symbols(spark, "/root/testdata/sf0.001").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_symbols_with_odd_attributes(spark):
    files = [
        (1, "<hibernate-mapping name='n'><class name=' ' entity-name='a.'><id name='i'/><property name=' '/><bean name='no'/></class><class name='.C'/></hibernate-mapping>"),
        (2, "<flow id='f'><view-state/><end-state id=' e '/><bean id='no'/><class name='no'/></flow>"), (3, "<beans><bean id='' name='' class='x.'/><bean id='' class='x.Y'/><class name='no'/></beans>"), (4, "<bean id='no'/>"),
    ]
    rows = dialects.elements(spark.createDataFrame(files, "k long, text string"), "k")
    got = dialects.xml_symbols(rows, "k", F.when(F.col("k") != 4, "s").otherwise("")).collect()
    assert sorted((r.k, r.name, r.qualified_name, r.kind, r.entity_class) for r in got) == [
        (1, "<anonymous-class>", "a.", "hibernate_class_mapping", "type"), (1, "C", ".C", "hibernate_class_mapping", "type"), (1, "i", "<class>.i", "hibernate_id", "field"),
        (2, "<state>", "s.<state>", "view_state", "other"), (2, "e", "s.e", "end_state", "other"), (2, "s", "s", "webflow_flow", "other"),
        (3, "<bean>", "<bean>", "spring_bean", "type"), (3, "Y", "Y", "spring_bean", "type"), (4, "bean", "bean", "xml_document", "other"),
    ]
    assert {r.symbol_id for r in got if r.k == 1} == {"xml:1:a.:1", "xml:1:.C:1", "xml:1:<class>.i:1"}


def test_places_of_many_matches(spark):
    texts = ["", "no", "ab", "ab ab", "xabyab", "ab" * 130, "é\x00ab\x00ab", "ab " * 20_000]
    began = time.time()
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", places(F.col("t"), "ab|no").alias("p")).collect()
    for r in got:
        assert [(p.start, p.end, p.match) for p in r.p] == [(m.start(), m.end(), m[0]) for m in re.finditer("ab|no", texts[r.i])]
    assert time.time() - began < 60


def test_types_after_names(spark):
    files = [
        (1, "python", "x: Order\nif a: Bee\ndef f(a: Foo, b: Dict[str, Bar] = {}) -> Optional[m.Baz]:\ndef g(self):\nelse:\nn: int = 1  # Note: Thing"),
        (2, "typescript", "export interface A {\n  b: Map<string, Bar>;\n  c(d?: Dee): void;\n  e: string;\n}\nfunction f(a: Foo): Promise<Baz> {\nconst o = { key: Value };"),
        (3, "java", "Order o;\n void f() throws java.io.IOException, Bad {\n // throws nothing"), (4, "python", None), (5, None, "x: Order"),
    ]
    df = spark.createDataFrame(files, "k long, language string, text string")
    got = sorted((r.k, r.line, r.predicate, r.type) for r in markup.annotated_type_refs(df, "k").collect())
    assert got == [(1, 1, "has_field_of_type", "Order"), (1, 3, "accepts_dto", "Bar"), (1, 3, "accepts_dto", "Foo"), (1, 3, "returns_dto", "Baz"), (2, 2, "has_field_of_type", "Bar"), (2, 3, "accepts_dto", "Dee"), (2, 6, "accepts_dto", "Foo"), (2, 6, "returns_dto", "Baz")]
    assert [(r.k, r.line, r.type) for r in markup.thrown(df, "k").collect()] == [(3, 2, "IOException"), (3, 2, "Bad")]
