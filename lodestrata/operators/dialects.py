"""Framework files in XML: persistence mappings, web flows and bean definitions, by their root element.

A small helper turns each file into a table of its elements with the nearest element that encloses them (a class, a state, a
bean); symbols and references are column functions of that table, without a join. Kinds of references are those that
graph.edge_kind knows. Null, empty and broken files give no rows; a repeated row repeats its rows."""

from __future__ import annotations

import xml.parsers.expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements of each dialect that enclose others, and those that say something themselves.
CLASSES = ("class", "subclass", "joined-subclass", "union-subclass")
FIELDS = ("property", "id", "version", "timestamp")
ASSOCIATIONS = ("many-to-one", "one-to-many", "many-to-many", "one-to-one")
STATES = ("view-state", "action-state", "decision-state", "end-state", "subflow-state")
MAPPING, FLOW, BEANS = "hibernate-mapping", "flow", "beans"
ENCLOSING = {MAPPING: CLASSES, FLOW: STATES, BEANS: ("bean",)}
TELLING = {MAPPING: (*CLASSES, *FIELDS, "column", *ASSOCIATIONS), FLOW: (*STATES, "evaluate", "transition"), BEANS: ("bean", "property", "constructor-arg")}
ATTRIBUTES = ("name", "entity-name", "table", "column", "class", "id", "subflow", "to", "expression", "ref")


def parse(text: str | None) -> list[tuple]:
    """(root, its line, ordinal, tag, line, attributes, ordinal, tag, line and attributes of the enclosing element) of the root and the
    elements that its dialect knows, in order; nothing of a broken file."""
    out, around, first, n_seen = [], [], ("", 0), 0
    parser = xml.parsers.expat.ParserCreate()

    def opened(tag, attrs):
        nonlocal first, n_seen
        line, up = parser.CurrentLineNumber, around[-1] if around else None
        if n_seen == 0:
            first = (tag, line)
        said = {k: v.strip() for k, v in attrs.items() if k in ATTRIBUTES}
        if n_seen == 0 or tag in TELLING.get(first[0], ()):
            out.append((*first, n_seen, tag, line, said, *(up or (None, None, None, None))))
        around.append((n_seen, tag, line, said) if tag in ENCLOSING.get(first[0], ()) else up)
        n_seen += 1

    parser.StartElementHandler, parser.EndElementHandler = opened, lambda _: around.pop()
    try:
        parser.Parse((text or "").encode("utf-8", errors="replace"), True)
    except xml.parsers.expat.ExpatError:
        return []
    return out


#: Elements of a batch that a task hands back.
BATCH = 8192


def elements(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, root, root_line, ord, tag, line, attrs, up_ord, up_tag, up_line, up_attrs. Files share batches of about BATCH elements."""
    import pyarrow as pa

    from ..shipping import ship

    ship(files.sparkSession)
    attrs = pa.map_(pa.string(), pa.string())
    columns = {"root": pa.string(), "root_line": pa.int64(), "ord": pa.int64(), "tag": pa.string(), "line": pa.int64(), "attrs": attrs, "up_ord": pa.int64(), "up_tag": pa.string(), "up_line": pa.int64(), "up_attrs": attrs}

    def said(values, kind):
        """A column; attributes as flat lists, as pairs cost several times as much."""
        if kind != attrs:
            return pa.array(values, kind)
        offsets, names, texts = [], [], []
        for x in values:
            offsets.append(None if x is None else len(names))
            if x:
                names.extend(x)
                texts.extend(x.values())
        return pa.MapArray.from_arrays(pa.array([*offsets, len(names)], pa.int32()), pa.array(names, pa.string()), pa.array(texts, pa.string()))

    def batch(keys, at, rows):
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *map(said, zip(*rows, strict=True), columns.values())], names=["k", *columns])

    def run(batches):
        for b in batches:
            keys, at, rows = b.column("k"), [], []
            for i, t in enumerate(b.column("t")):
                found = parse(t.as_py())
                for first in range(0, len(found), BATCH):
                    part = found[first : first + BATCH]
                    at += [i] * len(part)
                    rows += part
                    if len(rows) >= BATCH:
                        yield batch(keys, at, rows)
                        at, rows = [], []
            if rows:
                yield batch(keys, at, rows)

    kind = files.schema[key].dataType.simpleString()
    schema = f"k {kind}, root string, root_line long, ord long, tag string, line long, attrs map<string,string>, up_ord long, up_tag string, up_line long, up_attrs map<string,string>"
    return files.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def _said(name: str, of: str = "attrs") -> Column:
    """An attribute, null if it is absent or blank."""
    return F.nullif(F.col(of)[name], F.lit(""))


def _simple(name: Column) -> Column:
    return F.nullif(F.substring_index(name, ".", -1), F.lit(""))


def _class(of: str = "attrs") -> Column:
    return F.coalesce(_said("name", of), _said("entity-name", of))


def _symbol(of: str, flow: Column) -> tuple[Column, Column]:
    """Name and qualified name of the class, state or bean that attrs (of "") or the enclosing element (of "up_") is."""
    attrs, tag = f"{of}attrs", F.col(f"{of}tag")
    full, state, bean = _class(attrs), F.coalesce(_said("id", attrs), F.lit("<state>")), F.coalesce(_said("id", attrs), _said("name", attrs))
    simple = F.coalesce(_simple(full), F.lit("<anonymous-class>"))
    label = F.coalesce(bean, _simple(_said("class", attrs)), F.lit("<bean>"))
    name = F.when(tag.isin(*CLASSES), simple).when(tag.isin(*STATES), state).when(tag == "bean", label)
    return name, F.when(tag.isin(*CLASSES), F.coalesce(full, simple)).when(tag.isin(*STATES), F.concat(flow, F.lit("."), state)).when(tag == "bean", label)


def _identifier(key: str, qualified: Column, line: Column) -> Column:
    return F.concat_ws(":", F.lit("xml"), F.col(key).cast("string"), qualified, line.cast("string"))


def xml_symbols(rows: DataFrame, key: str, stem: Column) -> DataFrame:
    """key, symbol_id, name, qualified_name, kind, entity_class, line of elements; stem is a file's name without suffixes: the
    name of a flow, and of a file of another dialect."""
    root, tag, first, what = F.col("root"), F.col("tag"), F.col("ord") == 0, F.col("entity_class")
    of_mapping = F.when(tag.isin(*CLASSES), "hibernate_class_mapping").when(tag.isin(*FIELDS) & F.col("up_ord").isNotNull() & (F.col("attrs")["name"] != ""), F.concat(F.lit("hibernate_"), tag))
    of_flow = F.when(first, "webflow_flow").when(tag.isin(*STATES), F.replace(tag, F.lit("-"), F.lit("_")))
    kind = F.when(root == MAPPING, of_mapping).when(root == FLOW, of_flow).when(root == BEANS, F.when(tag == "bean", "spring_bean")).when(first, "xml_document")
    entity_class = F.when((root == BEANS) | (root == MAPPING) & tag.isin(*CLASSES), "type").when(root == MAPPING, "field").otherwise("other")
    rows = rows.filter(kind.isNotNull()).withColumns({"kind": kind, "entity_class": entity_class, "_stem": stem})
    # In steps, so that each attribute is looked up once: one long expression becomes code that the JVM does not compile.
    rows = rows.withColumn("_of", F.when(what == "field", F.col("up_attrs")).otherwise(F.col("attrs")))
    rows = rows.withColumns({f"_{n}": F.element_at(of, F.lit(n)) for of, n in (("attrs", "id"), ("attrs", "name"), ("attrs", "class"), ("_of", "entity-name"))} | {"_of": F.element_at("_of", F.lit("name"))})
    some_of, some_entity, some_class, some_id, some_name = (F.nullif(F.col(n), F.lit("")) for n in ("_of", "_entity-name", "_class", "_id", "_name"))
    rows = rows.withColumn("_full", F.when(root == BEANS, some_class).otherwise(F.coalesce(some_of, some_entity)))
    rows = rows.withColumn("_last", F.substring_index("_full", ".", -1))
    last, is_state = F.nullif(F.col("_last"), F.lit("")), (root == FLOW) & ~first
    name = (
        F.when(what == "field", F.col("_name")).when(root == MAPPING, F.coalesce(last, F.lit("<anonymous-class>"))).when(root == BEANS, F.coalesce(some_id, some_name, last, F.lit("<bean>")))
        .when(is_state, F.coalesce(some_id, F.lit("<state>"))).when(root == FLOW, F.col("_stem")).otherwise(F.coalesce(F.nullif(F.col("_stem"), F.lit("")), root))
    )
    rows = rows.withColumn("name", name)
    owner = F.when(what == "field", F.coalesce(last, F.lit("<class>"))).when(is_state, F.col("_stem"))
    qualified = F.when((what == "field") | is_state, F.concat(owner, F.lit("."), "name")).when(root == MAPPING, F.coalesce("_full", "name")).otherwise(F.col("name"))
    rows = rows.withColumn("qualified_name", qualified)
    return rows.select(key, _identifier(key, F.col("qualified_name"), F.col("line")).alias("symbol_id"), "name", "qualified_name", "kind", "entity_class", "line")


def xml_refs(rows: DataFrame, key: str, stem: Column) -> DataFrame:
    """key, name, kind, evidence, enclosing_id, line of references in elements: to the class that a mapping is for, its tables,
    columns and associations, methods, subflows and states of flows, classes of beans. enclosing_id is the symbol_id of the
    class, state or bean itself, or around; a flow's if no state is; null if there is none."""
    root, tag = F.col("root"), F.col("tag")
    (_, own), (_, around) = _symbol("", stem), _symbol("up_", stem)
    own, up = _identifier(key, own, F.col("line")), F.when(F.col("up_ord").isNotNull(), _identifier(key, around, F.col("up_line")))
    # A flow is the first element of its file; its line is the line of the root.
    of_flow = F.coalesce(up, _identifier(key, stem, F.col("root_line")))

    def ref(test, name, kind, evidence, where):
        return F.when(test & name.isNotNull(), F.struct(name.alias("name"), F.lit(kind).alias("kind"), F.substring(evidence, 1, 200).alias("evidence"), where.alias("enclosing_id")))

    quoted = lambda words, value: F.concat(F.lit(words) if isinstance(words, str) else words, F.lit('="'), value, F.lit('"'))
    mapping, flow, beans = root == MAPPING, root == FLOW, root == BEANS
    method = F.nullif(F.regexp_extract(_said("expression"), r"(?U)([A-Za-z_$][\w$]*)\s*\.\s*([A-Za-z_$][\w$]*)\s*\(", 2), F.lit(""))
    is_class, target = mapping & tag.isin(*CLASSES), _said("class")
    found = F.array(
        ref(is_class, _simple(_class()), "hibernate_entity", quoted("class name", _class()), own),
        ref(is_class, _said("table"), "hibernate_table", quoted("table", _said("table")), own),
        ref(mapping & tag.isin(*FIELDS), _said("column"), "hibernate_column", quoted("column", _said("column")), up),
        ref(mapping & (tag == "column"), _said("name"), "hibernate_column", quoted("column name", _said("name")), up),
        ref(mapping & tag.isin(*ASSOCIATIONS), _simple(target), "hibernate_association", quoted(F.concat(tag, F.lit(" class")), target), up),
        ref(flow & (tag == "subflow-state"), _said("subflow"), "webflow_subflow", quoted("subflow", _said("subflow")), own),
        ref(flow & (tag == "evaluate"), method, "webflow_evaluate", _said("expression"), of_flow),
        ref(flow & (tag == "transition"), _said("to"), "webflow_transition", quoted("transition to", _said("to")), of_flow),
        ref(beans & (tag == "bean"), _simple(target), "spring_bean_class", quoted("class", target), own),
    )
    rows = rows.select(key, "line", F.explode_outer(F.array_compact(found)).alias("r")).filter("r IS NOT NULL")
    return rows.select(key, "r.*", "line")


def xml_facts(files: DataFrame, key: str) -> DataFrame:
    """key, predicate, subject, object, line: what a file's elements say of the class, state or bean that they are or are in."""
    root, tag = F.col("root"), F.col("tag")
    own, up = F.coalesce(_said("name"), _said("id"), F.lit("")), F.coalesce(_said("name", "up_attrs"), _said("id", "up_attrs"), F.lit(""))
    fact = lambda p, subject, what: F.struct(F.lit(p).alias("predicate"), subject.alias("subject"), F.coalesce(what, F.lit("")).alias("object"))
    has = lambda name: _said(name).isNotNull()
    found = (
        F.when((root == MAPPING) & tag.isin(*CLASSES), fact("maps_to", F.coalesce(_class(), F.lit("")), _said("table")))
        .when((root == MAPPING) & tag.isin(*FIELDS) & has("column"), fact("has_column", up, _said("column")))
        .when((root == MAPPING) & (tag == "column") & has("name"), fact("has_column", up, _said("name")))
        .when((root == MAPPING) & tag.isin(*ASSOCIATIONS), fact("associates", up, _said("class")))
        .when((root == FLOW) & (tag == "transition") & has("to"), fact("transitions_to", up, _said("to")))
        .when((root == FLOW) & (tag == "subflow-state"), fact("invokes_subflow", own, _said("subflow")))
        .when((root == BEANS) & (tag == "bean"), fact("instantiates", F.coalesce(_said("id"), _said("name"), F.lit("")), _said("class")))
        .when((root == BEANS) & has("ref"), fact("references", F.coalesce(_said("id", "up_attrs"), up), _said("ref")))
    )
    return elements(files, key).select(key, found.alias("f"), "line").filter("f IS NOT NULL").select(key, "f.*", "line")
