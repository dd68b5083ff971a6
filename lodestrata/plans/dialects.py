"""Queries on SQL definitions and XML files made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ddl as D
from ..operators import dialects as X
from ..operators import graph as G
from .catalog import busy_table, query, table

MAPPING = "<?xml version='1.0'?>\n<!DOCTYPE hibernate-mapping [<!ELEMENT any (#PCDATA)>]>\n<hibernate-mapping><class name='m.E%d' table='t%d'><id name='id' column='ID'/>\n<property name='x'><column name='c%d'/></property>\n<joined-subclass name='m.S' table='s'>\n<many-to-many class='m.E%d'/></joined-subclass></class></hibernate-mapping>"
FLOW = "<flow>\n<on-start><evaluate expression='boot.up(%d)'/></on-start>\n<view-state id='s%d'><transition to='end'/>\n<evaluate expression='a.go(1) and b.stop()'/></view-state>\n<subflow-state id='u' subflow='f%d'/></flow>"
DDL = """-- %s, x INT
CREATE TABLE [dbo].[t_%d] (id INT PRIMARY KEY, "na,me" VARCHAR(10, 2) DEFAULT 'a, NOT NULL' NOT NULL, /* c INT, */ ref_id INT UNIQUE REFERENCES other(id), amount DOUBLE PRECISION,
  CHECK (id > 0), CONSTRAINT u UNIQUE (amount, [id]));
CREATE TABLE #work (n NVARCHAR(5));
ALTER TABLE [dbo].[t_%d] WITH CHECK ADD CONSTRAINT f FOREIGN KEY (ref_id) REFERENCES [dbo].[third_%d] ([key])
GO
CREATE TABLE never_closed (a INT"""


def _xml(spark, d):
    """A mapping with a joined subclass, a flow, beans, or a file of no dialect, by the part's number; and the files' names."""
    k = F.col("p_partkey")
    beans = F.format_string("<beans>\n<bean id='b%d' class='m.Impl%d'/></beans>", k, "p_size")
    text = F.when(k % 4 == 0, F.format_string(MAPPING, k, "p_size", "p_size", k + 1)).when(k % 4 == 1, F.format_string(FLOW, k, k, "p_size")).when(k % 4 == 2, beans)
    rows = busy_table(spark, d, "part").select(k, F.coalesce(text, F.lit("<notes><class name='x'/></notes>")).alias("text"))
    return X.elements(rows, "p_partkey"), F.concat(F.lit("file"), k.cast("string"))


_of = "SELECT p_partkey, {} FROM part WHERE p_partkey % 4 = {}"
_class, _file, _state, _sub = "concat('m.E', p_partkey)", "concat('file', p_partkey)", "concat('file', p_partkey, '.s', p_partkey)", "concat('file', p_partkey, '.u')"
_symbols = (
    (0, "concat('E', p_partkey)", _class, "hibernate_class_mapping", "type", 3), (0, "'id'", "concat('E', p_partkey, '.id')", "hibernate_id", "field", 3), (0, "'x'", "concat('E', p_partkey, '.x')", "hibernate_property", "field", 4),
    (0, "'S'", "'m.S'", "hibernate_class_mapping", "type", 5), (1, _file, _file, "webflow_flow", "other", 1), (1, "concat('s', p_partkey)", _state, "view_state", "other", 3), (1, "'u'", _sub, "subflow_state", "other", 5),
    (2, "concat('b', p_partkey)", "concat('b', p_partkey)", "spring_bean", "type", 2), (3, _file, _file, "xml_document", "other", 1),
)
_refs = (
    (0, "concat('E', p_partkey)", "hibernate_entity", """concat('class name="m.E', p_partkey, '"')""", _class, 3, "maps_to", 3), (0, "concat('t', p_size)", "hibernate_table", """concat('table="t', p_size, '"')""", _class, 3, "uses_table", 3),
    (0, "'ID'", "hibernate_column", """'column="ID"'""", _class, 3, "uses_column", 3), (0, "concat('c', p_size)", "hibernate_column", """concat('column name="c', p_size, '"')""", _class, 3, "uses_column", 4),
    (0, "'S'", "hibernate_entity", """'class name="m.S"'""", "'m.S'", 5, "maps_to", 5), (0, "'s'", "hibernate_table", """'table="s"'""", "'m.S'", 5, "uses_table", 5),
    (0, "concat('E', p_partkey + 1)", "hibernate_association", """concat('many-to-many class="m.E', p_partkey + 1, '"')""", "'m.S'", 5, "associates", 6),
    (1, "'up'", "webflow_evaluate", "concat('boot.up(', p_partkey, ')')", _file, 1, "calls", 2), (1, "'end'", "webflow_transition", """'transition to="end"'""", _state, 3, "transitions_to", 3), (1, "'go'", "webflow_evaluate", "'a.go(1) and b.stop()'", _state, 3, "calls", 4),
    (1, "concat('f', p_size)", "webflow_subflow", """concat('subflow="f', p_size, '"')""", _sub, 5, "invokes_subflow", 5), (2, "concat('Impl', p_size)", "spring_bean_class", """concat('class="m.Impl', p_size, '"')""", "concat('b', p_partkey)", 2, "instantiates", 2),
)


@query(" UNION ALL ".join(_of.format(f"concat('xml:', p_partkey, ':', {q}, ':{line}') AS symbol_id, {n} AS name, {q} AS qualified_name, '{kind}' AS kind, '{what}' AS entity_class, {line}::BIGINT AS line", r) for r, n, q, kind, what, line in _symbols))
def ex8_xml_symbols(spark, d):
    rows, stem = _xml(spark, d)
    return X.xml_symbols(rows, "p_partkey", stem)


@query(" UNION ALL ".join(_of.format(f"{n} AS name, '{kind}' AS kind, {said} AS evidence, concat('xml:', p_partkey, ':', {q}, ':{at}') AS enclosing_id, '{edge}' AS edge, {line}::BIGINT AS line", r) for r, n, kind, said, q, at, edge, line in _refs))
def ex8_xml_refs(spark, d):
    """References with the kind of edge that each becomes."""
    rows, stem = _xml(spark, d)
    return X.xml_refs(rows, "p_partkey", stem).withColumn("edge", G.edge_kind(F.col("kind"), F.col("name"), F.col("evidence"), F.lit("xml"), F.lit(None).cast("string")))


def _ddl(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, F.format_string(DDL, "p_name", k, k, "p_size").alias("ddl"))


_t = "concat('t_', p_partkey)"
_columns = (
    (_t, "false", "id", "INT", "false", "true", "false", "NULL", 2), (_t, "false", "na,me", "VARCHAR(10, 2)", "true", "false", "false", "NULL", 2), (_t, "false", "ref_id", "INT", "false", "false", "true", "'other'", 2),
    (_t, "false", "amount", "DOUBLE PRECISION", "false", "false", "false", "NULL", 2), ("'#work'", "true", "n", "NVARCHAR(5)", "false", "false", "false", "NULL", 4),
)
_keys = (
    (_t, "primary", "['id']", "NULL", "NULL", 2), (_t, "unique", "['ref_id']", "NULL", "NULL", 2), (_t, "foreign", "['ref_id']", "'other'", "NULL", 2), (_t, "unique", "['amount', 'id']", "NULL", "NULL", 3),
    (_t, "foreign", "['ref_id']", "concat('third_', p_size)", "['key']", 5),
)


@query(" UNION ALL ".join(f"SELECT p_partkey, {t} AS table_name, {temp} AS is_temp, '{c}' AS column_name, '{kind}' AS data_type, {nn} AS not_null, {pk} AS is_primary, {uq} AS is_unique, {ref}::VARCHAR AS refers_to, {line}::BIGINT AS line FROM part" for t, temp, c, kind, nn, pk, uq, ref, line in _columns))
def ex5_sql_columns(spark, d):
    """Definitions made from part, with comments, literals and names that hold commas, and a table that is never closed."""
    return D.sql_columns(_ddl(spark, d), "p_partkey", "ddl")


@query(" UNION ALL ".join(f"SELECT p_partkey, {t} AS table_name, '{kind}' AS kind, array_to_string({cols}, '+') AS columns, {ref}::VARCHAR AS refers_to, array_to_string({refs}::VARCHAR[], '+') AS refers_columns, {line}::BIGINT AS line FROM part" for t, kind, cols, ref, refs, line in _keys))
def ex5_sql_keys(spark, d):
    """Keys with a column, in a table's list, and added by ALTER TABLE."""
    keys = D.sql_keys(_ddl(spark, d), "p_partkey", "ddl")
    return keys.withColumn("columns", F.array_join("columns", "+")).withColumn("refers_columns", F.array_join("refers_columns", "+"))
