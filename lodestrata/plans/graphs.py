"""Interval, graph and domain queries on analogues: windows of documents as spans, parts as symbols, pages as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import domains as D
from ..operators import graph as G
from ..operators import intervals as I
from .catalog import query, table
from .texts import _win

_spans = f"{_win}, s AS (SELECT doc_id, concat(doc_id, ':', chunk) AS span_id, start_line, end_line FROM c)"
_cites = "k AS (SELECT item_id AS citation_id, item_id // 3 * 7919 % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, item_id % 23 + 1 AS start_line, item_id % 23 + 1 + item_id % 6 AS end_line FROM benchmark)"


def _windows(spark, d):
    w = I.windows(table(spark, d, "documents"), "doc_id", "text", 20, 4)
    return w.select("doc_id", F.concat_ws(":", "doc_id", "chunk").alias("span_id"), "start_line", "end_line")


def _citations(spark, d):
    i, last = F.col("item_id"), table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("last"))
    return table(spark, d, "benchmark").crossJoin(F.broadcast(last)).select(i.alias("citation_id"), (F.floor(i / 3) * 7919 % F.col("last")).alias("doc_id"), (i % 23 + 1).alias("start_line"), (i % 23 + 1 + i % 6).alias("end_line"))


@query(f"WITH {_spans}, {_cites} SELECT citation_id, k.doc_id, span_id FROM k LEFT JOIN s ON k.doc_id = s.doc_id AND s.start_line <= k.end_line AND s.end_line >= k.start_line")
def j3_overlap_join(spark, d):
    return I.overlapping(_citations(spark, d), _windows(spark, d), "doc_id", "citation_id").select("r.citation_id", "r.doc_id", "s.span_id")


@query(f"""WITH {_win}, w2 AS (SELECT concat('/repo/src/f', doc_id % 50, '/m', doc_id, '.py') AS path, concat(doc_id, ':', chunk) AS chunk_id, start_line, end_line FROM c),
    q AS (SELECT DISTINCT concat('f', item_id * 3 % 50, '/m', item_id * 3, '.py') AS p, item_id % 9 + 1 AS a, item_id % 9 + 30 AS b FROM benchmark)
    SELECT chunk_id, end_line - start_line + 1 AS span, path FROM w2 WHERE NOT EXISTS (SELECT 1 FROM q WHERE ends_with(w2.path, concat('/', q.p)) AND q.a <= w2.end_line AND q.b >= w2.start_line)""")
def j4_coverage(spark, d):
    w = _windows(spark, d)
    chunks = w.select(F.format_string("/repo/src/f%d/m%d.py", F.col("doc_id") % 50, "doc_id").alias("path"), F.col("span_id").alias("chunk_id"), "start_line", "end_line")
    i = F.col("item_id")
    cites = table(spark, d, "benchmark").select(F.format_string("x\\..\\f%d\\.\\m%d.py", i * 3 % 50, i * 3).alias("path"), (i % 9 + 30).alias("start_line"), (i % 9 + 1).alias("end_line"))
    return I.uncovered(I.coverage(chunks, cites)).select("chunk_id", "span", "path")


@query(f"WITH {_cites} SELECT DISTINCT a.citation_id AS id, b.citation_id AS other FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.start_line <= b.end_line AND a.end_line >= b.start_line AND a.citation_id <> b.citation_id")
def j5_citing_same_lines(spark, d):
    from ..operators.merge import overlap_pairs

    k = _citations(spark, d).select(F.col("citation_id").alias("id"), F.col("doc_id").alias("path"), "start_line", "end_line")
    return overlap_pairs(k, k)


@query(f"""WITH {_spans}, {_cites}, r AS (SELECT citation_id, span_id, s.end_line - s.start_line AS span, row_number() OVER (PARTITION BY citation_id ORDER BY s.end_line - s.start_line NULLS LAST, s.start_line, span_id) AS n
    FROM k LEFT JOIN s ON k.doc_id = s.doc_id AND s.start_line <= k.start_line AND s.end_line >= k.end_line) SELECT citation_id, span_id, span FROM r WHERE n = 1""")
def j6_innermost(spark, d):
    return I.innermost(_citations(spark, d), _windows(spark, d), "doc_id", "citation_id", "span_id")


@query(f"""WITH {_spans}, r AS (SELECT doc_id, span_id, row_number() OVER (PARTITION BY doc_id ORDER BY end_line - start_line, start_line, span_id) AS n FROM s) SELECT doc_id, span_id FROM r WHERE n = 1""")
def w4_argmin(spark, d):
    w = _windows(spark, d)
    return w.groupBy("doc_id").agg(F.min_by("span_id", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "span_id")).alias("span_id"))


@query(f"""WITH {_spans}, {_cites}, f AS (SELECT doc_id, doc_id % 3 <> 0 AS current FROM documents WHERE doc_id % 10 <> 4),
    h AS (SELECT citation_id, current, span_id, (s.start_line <= k.start_line AND s.end_line >= k.end_line) AS inside, s.end_line - s.start_line AS n, s.start_line AS b FROM k LEFT JOIN f USING (doc_id) LEFT JOIN s ON s.doc_id = k.doc_id AND s.start_line <= k.end_line AND s.end_line >= k.start_line),
    r AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY inside DESC NULLS LAST, n, b, span_id) AS i FROM h)
    SELECT citation_id, CASE WHEN current IS NULL THEN 'unresolved' WHEN NOT current OR span_id IS NULL THEN 'file' WHEN inside THEN 'contains' ELSE 'intersects' END AS resolution, CASE WHEN current AND span_id IS NOT NULL THEN span_id END AS span_id FROM r WHERE i = 1""")
def m1_anchor_resolution(spark, d):
    files = table(spark, d, "documents").filter("doc_id % 10 != 4").select("doc_id", (F.col("doc_id") % 3 != 0).alias("current"))
    return I.anchors(_citations(spark, d), files, _windows(spark, d), "doc_id")


_languages = "['java', 'cs', 'sql', 'cobol', 'xml', 'go']"
_symbols = f"sym AS (SELECT p_partkey AS symbol_id, p_brand AS path, {_languages}[p_size % 4 + 1] AS language, p_size::BIGINT AS start_line, p_size::BIGINT + p_partkey % 30 AS end_line, concat('n', p_partkey % 400) AS name, concat('q.n', p_partkey % 700) AS qualified_name, ['class_declaration', 'interface_declaration', 'table'][p_partkey % 3 + 1] AS kind FROM part)"
_refs = f"ref AS (SELECT event_id AS ref_id, concat(CASE event_id % 3 WHEN 0 THEN 'q.n' ELSE 'n' END, event_id % 900) AS name, {_languages}[user_id % 6 + 1] AS language, concat('Brand#', user_id % 25) AS path, event_id % 40 + 1 AS start_line, event_id % 40 + 1 + event_id % 3 AS end_line, CASE WHEN event_id % 11 = 0 THEN event_id % 50 END AS enclosing_id FROM events)"


def _pick(values, k):
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


LANGUAGES = ("java", "cs", "sql", "cobol", "xml", "go")
KINDS = ("extends", "implements", "inherits_or_implements", "method_invocation", "object_creation", "foreign_key", "using_directive", "zzz", "hibernate_table", "webflow_transition", "exec_sql_block", "table_reference", "perform_statement")


def _symbol_rows(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        k.alias("symbol_id"), F.col("p_brand").alias("path"), _pick(LANGUAGES, size % 4).alias("language"), size.cast("long").alias("start_line"), (size.cast("long") + k % 30).alias("end_line"),
        F.concat(F.lit("n"), k % 400).alias("name"), F.concat(F.lit("q.n"), k % 700).alias("qualified_name"), _pick(("class_declaration", "interface_declaration", "table"), k % 3).alias("kind"),
    )


def _ref_rows(spark, d):
    e = F.col("event_id")
    said = F.when(e % 7 == 0, "exec sql select x from t").when(e % 7 == 1, "PERFORM X").when(e % 7 == 2, "new Foo()").when(e % 7 == 3, "exec cics x").when(e % 7 == 4, "call y").otherwise(F.col("props"))
    return table(spark, d, "events").select(
        e.alias("ref_id"), F.concat(F.when(e % 3 == 0, "q.n").otherwise("n"), e % 900).alias("name"), _pick(LANGUAGES, F.col("user_id") % 6).alias("language"), F.concat(F.lit("Brand#"), F.col("user_id") % 25).alias("path"),
        (e % 40 + 1).alias("start_line"), (e % 40 + 1 + e % 3).alias("end_line"), F.when(e % 11 == 0, e % 50).alias("enclosing_id"), _pick(KINDS, e % 13).alias("kind"), said.alias("evidence"), "user_id",
    )


@query(f"""WITH {_symbols}, {_refs}, n AS (SELECT symbol_id, path, language, start_line, unnest(list_distinct([name, qualified_name])) AS name FROM sym),
    j AS (SELECT ref_id, symbol_id, n.language = ref.language AS own, row_number() OVER (PARTITION BY ref_id ORDER BY n.language = ref.language DESC NULLS LAST, n.path <> ref.path, n.path, n.start_line, symbol_id) AS i, count(symbol_id) OVER (PARTITION BY ref_id) AS k FROM ref LEFT JOIN n ON n.name = ref.name)
    SELECT ref_id, CASE WHEN k = 1 OR (k > 1 AND own) THEN symbol_id END AS callee_id, CASE WHEN k = 0 THEN 0.3 WHEN k = 1 THEN 0.85 WHEN own THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence, k AS candidates FROM j WHERE i = 1""")
def j7_name_resolution(spark, d):
    return G.resolve(_ref_rows(spark, d), _symbol_rows(spark, d))


_ev = "SELECT event_id, user_id, [" + ", ".join(f"'{k}'" for k in KINDS) + f"][event_id % 13 + 1] AS kind, CASE event_id % 5 WHEN 0 THEN 'IThing' WHEN 1 THEN 'Item' ELSE 'base' END AS name, {_languages}[user_id % 6 + 1] AS language, CASE event_id % 4 WHEN 1 THEN 'interface_declaration' WHEN 2 THEN 'class_declaration' END AS callee_kind, CASE event_id % 7 WHEN 0 THEN 'exec sql select x from t' WHEN 1 THEN 'PERFORM X' WHEN 2 THEN 'new Foo()' WHEN 3 THEN 'exec cics x' WHEN 4 THEN 'call y' ELSE props END AS evidence FROM events"
_said = "upper(coalesce(evidence, ''))"
_kind = f"""CASE WHEN kind = 'inherits_or_implements' THEN CASE WHEN callee_kind = 'interface_declaration' THEN 'implements' WHEN callee_kind IS NOT NULL THEN 'inherits' WHEN regexp_matches(name, '^I[A-Z]') THEN 'implements' ELSE 'inherits' END
    WHEN kind = 'implements' THEN 'implements' WHEN kind = 'extends' THEN 'inherits' WHEN kind = 'foreign_key' THEN 'foreign_key'
    WHEN language = 'xml' THEN CASE kind WHEN 'hibernate_table' THEN 'uses_table' WHEN 'webflow_transition' THEN 'transitions_to' ELSE 'references' END
    WHEN language = 'cobol' AND contains({_said}, 'EXEC SQL') THEN 'executes_sql' WHEN language = 'cobol' AND contains({_said}, 'EXEC CICS') THEN 'executes_cics' WHEN language = 'cobol' AND (contains({_said}, 'PERFORM') OR contains(kind, 'perform')) THEN 'performs'
    WHEN language = 'cobol' AND contains({_said}, 'CALL') THEN 'calls' WHEN language = 'cobol' AND contains(kind, 'exec') AND contains(kind, 'sql') THEN 'executes_sql'
    WHEN language = 'sql' AND contains(kind, 'exec') THEN 'calls' WHEN language = 'sql' AND (regexp_matches({_said}, 'FROM|JOIN|UPDATE|INTO') OR contains(kind, 'table_reference')) THEN 'uses_table'
    WHEN contains(kind, 'import') OR contains(kind, 'using') THEN 'imports' WHEN contains(kind, 'invocation') OR contains(kind, 'object_creation') THEN 'calls' ELSE 'references' END"""


def _edges(spark, d):
    e = F.col("ref_id")
    rows = _ref_rows(spark, d).withColumns({"name": F.when(e % 5 == 0, "IThing").when(e % 5 == 1, "Item").otherwise("base"), "callee_kind": F.when(e % 4 == 1, "interface_declaration").when(e % 4 == 2, "class_declaration")})
    return rows.select(e.alias("event_id"), "user_id", G.edge_kind(F.col("kind"), F.col("name"), F.col("evidence"), F.col("language"), F.col("callee_kind")).alias("edge_kind"))


@query(f"SELECT edge_kind, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, {_kind} AS edge_kind FROM ({_ev})) GROUP BY 1")
def g2_edge_kind(spark, d):
    return _edges(spark, d).groupBy("edge_kind").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(f"""WITH {_symbols}, {_refs}, n AS (SELECT symbol_id, path, language, start_line, unnest(list_distinct([name, qualified_name])) AS name FROM sym),
    j AS (SELECT ref_id, symbol_id, n.language = ref.language AS own, row_number() OVER (PARTITION BY ref_id ORDER BY n.language = ref.language DESC NULLS LAST, n.path <> ref.path, n.path, n.start_line, symbol_id) AS i, count(symbol_id) OVER (PARTITION BY ref_id) AS k FROM ref LEFT JOIN n ON n.name = ref.name),
    c AS (SELECT ref_id, CASE WHEN k = 1 OR (k > 1 AND own) THEN symbol_id END AS callee_id, CASE WHEN k = 0 THEN 0.3 WHEN k = 1 THEN 0.85 WHEN own THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM j WHERE i = 1),
    a AS (SELECT ref_id, symbol_id AS around, row_number() OVER (PARTITION BY ref_id ORDER BY s.end_line - s.start_line, s.start_line, symbol_id) AS i FROM ref JOIN sym s ON s.path = ref.path AND s.start_line <= ref.start_line AND s.end_line >= ref.end_line),
    e AS (SELECT v.* REPLACE (ref.name AS name, sym.kind AS callee_kind), ref_id, coalesce(enclosing_id, around) AS caller_id, callee_id, confidence FROM ({_ev}) v JOIN ref ON ref_id = event_id JOIN c USING (ref_id) LEFT JOIN (SELECT ref_id, around FROM a WHERE i = 1) a USING (ref_id) LEFT JOIN sym ON symbol_id = callee_id)
    SELECT ref_id, caller_id, callee_id, {_kind} AS edge_kind, confidence FROM e""")
def g1_edges(spark, d):
    return G.edges(_ref_rows(spark, d), _symbol_rows(spark, d))


@query(f"SELECT event_id, user_id, edge_kind FROM (SELECT *, {_kind} AS edge_kind FROM ({_ev})) WHERE user_id = 7 AND edge_kind IN ('calls', 'implements')")
def f4_edges_of(spark, d):
    return _edges(spark, d).filter((F.col("user_id") == 7) & F.col("edge_kind").isin("calls", "implements"))


@query("SELECT event_id, event_type, true AS fallback FROM events WHERE user_id % 2 = 0 AND event_type = 'click'")
def f5_fallback(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 1, F.col("user_id")).alias("callee_id"), F.col("event_type").alias("callee_name"), F.lit("calls").alias("edge_kind"))
    return G.callers(e, -5, "click").select("event_id", "event_type", "fallback")


PATTERNS = [("**/en/**", "english"), ("**/fr/*", "french"), ("*.com/**", "commercial"), ("**/9*", "nines"), ("/static/", "excluded")]
_path = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_globs = f"g AS (SELECT page_id, p, list_distinct(list_filter([CASE WHEN regexp_matches(p, '^(.*/)?en/.*(/.*)?$') THEN 'english' END, CASE WHEN regexp_matches(p, '^(.*/)?fr/[^/]*(/.*)?$') THEN 'french' END, CASE WHEN regexp_matches(p, '^[^/]*\\.com/.*(/.*)?$') THEN 'commercial' END, CASE WHEN regexp_matches(p, '^(.*/)?9[^/]*(/.*)?$') THEN 'nines' END], lambda x: x IS NOT NULL)) AS ds, CASE WHEN regexp_matches(p, '^(.*/)?en/.*(/.*)?$') THEN 'english' WHEN regexp_matches(p, '^(.*/)?fr/[^/]*(/.*)?$') THEN 'french' WHEN regexp_matches(p, '^[^/]*\\.com/.*(/.*)?$') THEN 'commercial' WHEN regexp_matches(p, '^(.*/)?9[^/]*(/.*)?$') THEN 'nines' END AS domain FROM (SELECT page_id, {_path} AS p FROM pages))"


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("p"))


@query(f"WITH {_globs} SELECT page_id, domain, len(ds)::BIGINT AS matches FROM g")
def w3_first_glob(spark, d):
    return D.resolve_globs(_pages(spark, d), PATTERNS, "p").select("page_id", "domain", "matches")


def _tagged(spark, d):
    files = _pages(spark, d).withColumn("k", F.col("page_id").cast("string"))
    manual = files.filter("page_id % 9 = 0").select("p", F.when(F.col("page_id") % 18 == 0, "excluded").otherwise("manual").alias("domain")).groupBy("p").agg(F.min("domain").alias("domain"))
    return D.reconcile(files.select("p").distinct(), PATTERNS, manual, "p")


_tag = f"{_globs}, m AS (SELECT p, min(CASE WHEN page_id % 18 = 0 THEN 'excluded' ELSE 'manual' END) AS hand FROM g WHERE page_id % 9 = 0 GROUP BY p), t AS (SELECT DISTINCT g.p, coalesce(hand, domain, 'unassigned') AS domain, CASE WHEN hand IS NOT NULL THEN 'manual' WHEN domain IS NOT NULL THEN 'glob' ELSE 'none' END AS source FROM g LEFT JOIN m ON g.p = m.p)"


@query(f"WITH {_tag} SELECT p, domain, source FROM t")
def m11_reconcile(spark, d):
    return _tagged(spark, d)


@query(f"""WITH {_tag} SELECT count(*) AS discovered, count(*) FILTER (domain = 'excluded') AS excluded, count(*) FILTER (domain = 'unassigned') AS unassigned, count(*) FILTER (domain IS NULL) AS untagged,
    count(*) FILTER (domain NOT IN ('excluded', 'unassigned')) AS classified, round(100.0::DOUBLE * count(*) FILTER (domain NOT IN ('excluded', 'unassigned')) / greatest(1, count(*) - count(*) FILTER (domain = 'excluded')), 4) AS coverage_pct FROM t""")
def a13_freshness(spark, d):
    return D.freshness(_tagged(spark, d))


@query("""SELECT concat('flowchart LR') AS line UNION ALL SELECT CASE WHEN r_regionkey % 2 = 0 THEN concat('    r', r_regionkey, '(["', r_name, '"])') ELSE concat('    r', r_regionkey, '["', r_name, '"]') END FROM region
    UNION ALL SELECT DISTINCT concat('    r', n_regionkey, ' -->|uses| r', n_nationkey % 7) FROM nation WHERE n_nationkey % 7 < 5""")
def sk6_mermaid(spark, d):
    nodes = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("domain_id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, "shared").otherwise("plain").alias("kind"))
    edges = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("from_domain"), F.concat(F.lit("r"), F.col("n_nationkey") % 7).alias("to_domain"), F.lit("uses").alias("label")).distinct()
    return D.mermaid(nodes, edges)
