"""Extraction queries on code, mappings and exports made from parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialects as X
from ..operators import graph as G
from ..operators import markup as M
from ..sources.files import parsed_domains
from .catalog import busy_table, query, table

JAVA = "public class C%d extends Base%d implements I%d, Shared<T> {\n  private Order%d order;\n  int plain;\n  Integer boxed = 1;\n  public List<Item> find(Long id, Query q) throws Bad {\n    return new Foo(x);\n  }\n}"


def _java(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.lit("java").alias("language"), F.format_string(JAVA, k, k % 9, k % 5, k % 7).alias("text"))


@query("SELECT p_partkey, 'java' AS language, concat('C', p_partkey) AS name, 1::BIGINT AS line FROM part")
def ex1_definitions(spark, d):
    return M.definitions(_java(spark, d), "p_partkey")


@query("SELECT p_partkey, 1::BIGINT AS line, concat('C', p_partkey) AS child, 'extends' AS kind, concat('Base', p_partkey % 9) AS parent FROM part UNION ALL SELECT p_partkey, 1, concat('C', p_partkey), 'implements', concat('I', p_partkey % 5) FROM part UNION ALL SELECT p_partkey, 1, concat('C', p_partkey), 'implements', 'Shared' FROM part")
def ex3_inheritance(spark, d):
    return M.inheritance(_java(spark, d), "p_partkey")


@query("SELECT p_partkey, 2::BIGINT AS line, 'has_field_of_type' AS predicate, concat('Order', p_partkey % 7) AS type FROM part UNION ALL SELECT p_partkey, 5, 'returns_dto', 'Item' FROM part UNION ALL SELECT p_partkey, 5, 'accepts_dto', 'Query' FROM part")
def ex7_type_refs(spark, d):
    return M.type_refs(_java(spark, d), "p_partkey")


TYPED = {
    "python": "class C%d(B):\n    owner: Order%d = None\n    async def find(self, id: int, q: Optional[Query] = None, *rest: m.Item) -> List[Claim%d]:\n        total: int = 1\n",
    "typescript": "export class C%d {\n  private order?: Order%d;\n  async find(id: number, q: Query = x, ...rest: Item[]): Promise<Claim%d> {\n    return new Foo(x);\n",
}


@query(" UNION ALL ".join(f"SELECT p_partkey, {line}::BIGINT AS line, '{p}' AS predicate, {t} AS type FROM part" for line, p, t in ((2, "has_field_of_type", "concat('Order', p_partkey % 7)"), (3, "returns_dto", "concat('Claim', p_size)"), (3, "accepts_dto", "'Query'"), (3, "accepts_dto", "'Item'"))))
def ex7_annotated_types(spark, d):
    """Types after names, in Python and TypeScript by turns."""
    k = F.col("p_partkey")
    text = [F.format_string(t, k, k % 7, "p_size") for t in TYPED.values()]
    rows = table(spark, d, "part").select("p_partkey", F.when(k % 2 == 0, "python").otherwise("typescript").alias("language"), F.when(k % 2 == 0, text[0]).otherwise(text[1]).alias("text"))
    return M.annotated_type_refs(rows, "p_partkey")


@query("SELECT p_partkey, 5::BIGINT AS line, 'Bad' AS type FROM part")
def ex7_thrown(spark, d):
    return M.thrown(_java(spark, d), "p_partkey")


@query("SELECT p_partkey, 'maps_to' AS predicate, concat('E', p_partkey) AS subject, concat('t', p_size) AS object, 1::BIGINT AS line FROM part UNION ALL SELECT p_partkey, 'has_column', concat('E', p_partkey), 'c1', 2 FROM part")
def ex8_xml_facts(spark, d):
    text = F.format_string("<hibernate-mapping><class name='E%d' table='t%d'>\n<property name='x' column='c1'/></class></hibernate-mapping>", "p_partkey", "p_size")
    return X.xml_facts(busy_table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey")


@query("SELECT concat(l_orderkey, '>', l_partkey) AS id, min(l_orderkey) AS caller, min(l_partkey) AS callee FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_linenumber < 3 GROUP BY 1")
def g3_rebuild_edges(spark, d):
    """Changed and unchanged references together, each edge once."""
    rows = table(spark, d, "lineitem").select(F.concat_ws(">", "l_orderkey", "l_partkey").alias("id"), F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"), "l_linenumber")
    changed, rest = rows.filter("caller % 3 != 0"), rows.filter("caller % 3 = 0 AND l_linenumber < 3")
    return changed.unionByName(rest).drop("l_linenumber").dropDuplicates(["id"])


@query("SELECT l_orderkey AS caller, l_linenumber FROM lineitem WHERE l_partkey = 5")
def g4_one_hop(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee_id"), "l_linenumber", F.lit("x").alias("callee_name"), F.lit("calls").alias("edge_kind"))
    return G.callers(edges, 5, "none").select("caller", "l_linenumber")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 = 0 AND lang IS NOT NULL")
def sc5_jsonl_import(spark, d):
    """Documents as JSON lines, some without a key, read back with a fixed schema."""
    lines = table(spark, d, "documents").select(F.to_json(F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("doc_id"), "lang", "n_chars")).alias("line"))
    return lines.select(F.from_json("line", "doc_id long, lang string, n_chars long").alias("r")).select("r.*").filter("doc_id IS NOT NULL")


@query("SELECT e.name AS file_name, l.language FROM (SELECT concat('f', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.java' WHEN 2 THEN '.none' ELSE '' END) AS name, CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.none' END AS ext FROM part) e LEFT JOIN (SELECT unnest(['.py', '.java']) AS ext, unnest(['Python', 'Java']) AS language) l ON e.ext = l.ext")
def sc11_extension_lookup(spark, d):
    known = spark.createDataFrame([(".py", "Python"), (".java", "Java")], "ext string, language string")
    k = F.col("p_partkey") % 4
    name = F.concat(F.lit("f"), "p_partkey", F.when(k == 0, ".PY").when(k == 1, ".java").when(k == 2, ".none").otherwise(""))
    rows = table(spark, d, "part").select(name.alias("file_name")).withColumn("ext", F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1)))
    return rows.join(F.broadcast(known), "ext", "left").select("file_name", "language")


@query("SELECT run_id, outcome, count(*) AS hits, min(event_id) AS first_offer FROM (SELECT user_id % 10 AS run_id, event_type AS outcome, event_id FROM events) GROUP BY 1, 2")
def sk10_run_audit(spark, d):
    from ..operators.store import run_audit

    return run_audit(table(spark, d, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("outcome"), F.col("event_id").alias("ordinal")))


@query("""SELECT concat('{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '"}') AS line FROM customer""")
def sk7_json_rows(spark, d):
    return table(spark, d, "customer").select(F.to_json(F.struct("c_custkey", "c_mktsegment")).alias("line"))


@query("SELECT vec_id, coalesce(lang, '') AS language, coalesce(source, '') AS domain FROM embeddings LEFT JOIN documents ON vec_id = doc_id WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id, 'new', '' FROM embeddings WHERE vec_id % 10 = 0")
def sk8_vector_upsert(spark, d):
    from ..operators.report import upsert

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    ids = table(spark, d, "embeddings").select("vec_id")
    stored = ids.join(docs, "vec_id", "left").select("vec_id", F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("domain"))
    return upsert(stored, ids.filter("vec_id % 10 = 0").select("vec_id", F.lit("new").alias("language"), F.lit("").alias("domain")), ["vec_id"])


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS lexical, b.k IS NOT NULL AS vector FROM (SELECT doc_id AS k FROM documents WHERE contains(lower(text), 'the')) a FULL JOIN (SELECT vec_id AS k FROM embeddings WHERE label = (SELECT min(label) FROM embeddings)) b ON a.k = b.k")
def u2_candidate_union(spark, d):
    """What two searches over all rows find, each candidate once, with the searches that found it."""
    vectors = table(spark, d, "embeddings")
    least = vectors.agg(F.min("label").alias("label"))
    a = table(spark, d, "documents").filter(F.lower("text").contains("the")).select(F.col("doc_id").alias("k"), F.lit(True).alias("x"))
    b = vectors.join(F.broadcast(least), "label", "left_semi").select(F.col("vec_id").alias("k"), F.lit(True).alias("y"))  # one row
    return a.join(b, "k", "full_outer").select("k", F.col("x").isNotNull().alias("lexical"), F.col("y").isNotNull().alias("vector"))


@query("SELECT n_regionkey AS catalogue, concat('d', n_nationkey) AS domain_id, n_name AS name, 2::BIGINT AS n_globs FROM nation")
def sc4_domains_json(spark, d):
    """A domain catalogue a region as JSON text, read back with the fixed schema."""
    domain = F.struct(F.concat(F.lit("d"), "n_nationkey").alias("domain_id"), F.col("n_name").alias("name"), F.array(F.concat("n_name", F.lit("/**")), F.lit("**/*.md")).alias("path_globs"))
    texts = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("catalogue")).agg(F.to_json(F.struct(F.collect_list(domain).alias("domains"))).alias("c"))
    return parsed_domains(texts, "c").select("catalogue", F.explode("c.domains").alias("x")).select("catalogue", "x.domain_id", "x.name", F.size("x.path_globs").cast("long").alias("n_globs"))
