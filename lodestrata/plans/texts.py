"""Text queries: windows, estimates, keys, incremental splits, extraction, citations and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract as E
from ..operators import intervals as I
from ..operators import report as R
from .catalog import busy_table, query, table

_win = """w AS (SELECT doc_id, l, unnest(range(0, CAST(ceil(greatest(len(l) - 20, 0) / 16) AS BIGINT) + 1)) AS chunk FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    c AS (SELECT doc_id, chunk, chunk * 16 + 1 AS start_line, chunk * 16 + len(l[chunk * 16 + 1:chunk * 16 + 20]) AS end_line, array_to_string(l[chunk * 16 + 1:chunk * 16 + 20], chr(10)) AS chunk_text FROM w)"""
_est = r"""CAST(len(list_filter(string_split_regex(text, '[\s.,;:()\[\]{}<>"''`!?@#$%^&*+=|\\~]+'), lambda x: x <> '')) AS BIGINT)"""
_terms = "required|stringlength|maxlength|minlength|range|regularexpression|emailaddress|phone|creditcard|compare|validation|validate|key|foreignkey|column|table|index|notmapped|concurrencycheck|timestamp|datatype|notnull|notblank|notempty|size|min|max|pattern|valid|validated|positive|negative|past|future|digits|assert|constraint|entity|joincolumn|onetomany|manytoone|manytomany|validator|field_validator|constr|conint"
_logic = f"(regexp_matches(text, '(?i)(^|[^\\pL\\pN_])({_terms})([^\\pL\\pN_]|$)') OR regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(if|else|switch|case|for|foreach|while|throw|raise|check|unique|not\\s+null|default|constraint)([^\\pL\\pN_]|$)') OR regexp_matches(text, '==|!=|<=|>=|&&|\\|\\|') OR regexp_matches(text, '(?i)(^|[^\\pL\\pN_])return([^\\pL\\pN_\\n][^\\n]*)?[<>=!]'))"


@query(f"WITH {_win} SELECT doc_id, chunk, start_line, end_line, sha256(chunk_text) AS sha FROM c")
def ch1_line_windows(spark, d):
    return I.windows(table(spark, d, "documents"), "doc_id", "text", 20, 4).select("doc_id", "chunk", "start_line", "end_line", F.sha2("chunk_text", 256).alias("sha"))


@query(f"""WITH {_win}, s AS (SELECT doc_id, chunk, start_line, end_line, {_est.replace('text', 'chunk_text')} AS tokens FROM c WHERE chunk_text <> ''),
    k AS (SELECT * FROM s WHERE tokens <= 260), n AS (SELECT doc_id, len(string_split(text, chr(10))) AS total FROM documents)
    SELECT doc_id, sum(end_line - start_line + 1)::BIGINT AS symbol_lines, any_value(total)::BIGINT AS total_lines, sum(end_line - start_line + 1) / any_value(total) >= 0.3 AS accepted FROM k JOIN n USING (doc_id) GROUP BY doc_id""")
def ch2_symbol_gate(spark, d):
    docs = busy_table(spark, d, "documents")
    spans = I.windows(docs, "doc_id", "text", 20, 4).filter("chunk_text != ''")
    return E.symbol_gate(spans.withColumn("tokens", X.token_estimate(F.col("chunk_text"))), docs.select("doc_id", F.size(X.lines(F.col("text"))).alias("total")), "doc_id", 130)


@query(f"""WITH {_win}, d AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS total, CASE doc_id % 3 WHEN 0 THEN 40 WHEN 1 THEN length(text) ELSE 0 END AS z, CASE doc_id % 3 WHEN 0 THEN 1 ELSE total END AS e FROM documents),
    s AS (SELECT doc_id, substr(text, 1, z) AS chunk_text, e, total FROM d WHERE z > 0), k AS (SELECT * FROM s WHERE trim(replace(replace(replace(chunk_text, chr(10), ' '), chr(13), ' '), chr(9), ' ')) <> '' AND {_est.replace('text', 'chunk_text')} <= 260), good AS (SELECT * FROM k WHERE e / total >= 0.3)
    SELECT doc_id, 'symbol' AS kind, 1::BIGINT AS start_line, e::BIGINT AS end_line, sha256(chunk_text) AS sha FROM good UNION ALL SELECT doc_id, 'window', start_line, end_line, sha256(chunk_text) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM good)""")
def ch2_chunks(spark, d):
    """A third of the documents with one symbol in their first line, a third with one over all of it, a third with none."""
    docs, i = busy_table(spark, d, "documents"), F.col("doc_id") % 3
    end = F.when(i == 0, 40).when(i == 1, F.char_length("text")).otherwise(0)
    symbols = docs.select("doc_id", F.lit(0).alias("start"), end.alias("end"), F.lit(1).alias("start_line"), F.when(i == 0, 1).otherwise(F.size(X.lines(F.col("text")))).alias("end_line"))
    found = I.chunked(docs.select("doc_id", "text"), symbols, "doc_id", "text", 130, 20, 4)
    return found.select("doc_id", "kind", "start_line", "end_line", F.sha2("chunk_text", 256).alias("sha"))


@query(f"SELECT doc_id, {_est} AS tokens FROM documents")
def ch4_token_estimate(spark, d):
    return busy_table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, ({_est} >= 80 OR {_logic}) AS embed, {_logic} AS logic FROM documents")
def f9_embed_filter(spark, d):
    t = F.col("text")
    return busy_table(spark, d, "documents").select("doc_id", X.should_embed(t, 80).alias("embed"), X.has_logic(t).alias("logic"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS members FROM documents GROUP BY 1")
def a15_text_dedupe(spark, d):
    return R.first_seen(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "sha", "doc_id")


@query("""WITH i AS (SELECT concat(doc_id::VARCHAR, chr(9), sha256(text), chr(10)) AS item FROM documents),
    b AS (SELECT substr(sha256(item), 1, 5) AS bucket, sha256(array_to_string(list_sort(list(item)), '')) AS h FROM i GROUP BY 1),
    c AS (SELECT substr(bucket, 1, 2) AS top, sha256(array_to_string(list_sort(list(concat(bucket, h))), '')) AS h FROM b GROUP BY 1)
    SELECT sha256(array_to_string(list_sort(list(concat(top, h))), '')) AS set_hash FROM c""")
def a16_set_hash(spark, d):
    return R.set_hash(table(spark, d, "documents"), F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.sha2("text", 256), F.lit("\n")))


def _previous(spark, d):
    """An earlier state of documents: some rows missing, some texts different."""
    docs = table(spark, d, "documents").filter("doc_id % 5 != 0")
    return docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"))


_prev = "prev AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 0)"


@query(f"WITH {_prev} SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM prev WHERE prev.doc_id = documents.doc_id AND prev.sha = sha256(documents.text))")
def j9_incremental_anti(spark, d):
    now = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))
    return now.join(_previous(spark, d), ["doc_id", "sha"], "left_anti")


@query(f"""WITH {_prev}, cur AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(prev.doc_id, cur.doc_id) AS doc_id, CASE WHEN prev.doc_id IS NULL THEN 'added' WHEN cur.doc_id IS NULL THEN 'deleted' WHEN prev.sha = cur.sha THEN 'unchanged' ELSE 'changed' END AS status
    FROM prev FULL JOIN cur ON prev.doc_id = cur.doc_id""")
def j11_change_split(spark, d):
    now = table(spark, d, "documents").filter("doc_id % 11 != 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    return R.change_split(_previous(spark, d), now, "doc_id", "sha")


@query("""SELECT p_partkey, concat('ak1:', substr(sha256(concat_ws(chr(31), p_brand, 'part', coalesce(p_name, ''), '')), 1, 16)) AS anchor_key,
    concat('dk1:', substr(sha256(concat_ws(chr(31), array_to_string(list_sort(list_distinct([p_brand, p_type])), chr(31)), p_type, p_size::VARCHAR)), 1, 16)) AS dedupe_key FROM part""")
def k1_keys(spark, d):
    anchors = X.set_text(F.array("p_brand", "p_type"))
    return table(spark, d, "part").select("p_partkey", X.key("ak1:", F.col("p_brand"), F.lit("part"), F.col("p_name"), F.lit(None).cast("string")).alias("anchor_key"), X.key("dk1:", anchors, F.col("p_type"), F.col("p_size")).alias("dedupe_key"))


@query(r"""SELECT doc_id, concat('ch1:', substr(sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\v]+\n', chr(10), 'g'), '[ \t\f\v]+$', '', 'g'), '^\n+|\n+$', '', 'g')), 1, 16)) AS content_hash FROM documents""")
def m2_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.key("ch1:", X.body(F.col("text"))).alias("content_hash"))


@query("SELECT page_id, map_extract_value(MAP {'.cs': 'csharp', '.java': 'java', '.py': 'python', '.js': 'javascript', '.jsx': 'javascript', '.mjs': 'javascript', '.cjs': 'javascript', '.ts': 'typescript', '.tsx': 'typescript', '.cbl': 'cobol', '.cob': 'cobol', '.cpy': 'cobol', '.copy': 'cobol', '.pco': 'cobol', '.sql': 'sql', '.ddl': 'sql', '.dml': 'sql', '.psql': 'sql', '.pgsql': 'sql', '.tsql': 'sql', '.xml': 'xml', '.jsp': 'jsp', '.properties': 'properties', '.css': 'css', '.vm': 'velocity', '.ent': 'xml_entity', '.tld': 'tld', '.xmi': 'xmi'}, regexp_extract(lower(url), '(\\.[^./]+)$', 1)) AS language FROM (SELECT page_id, concat(url, ['.JS', '.py', '.zzz', '.xml', '.cpy', '.DDL', '.jsp', '.mjs', '.go', '.rb', '.php', '.vm', '.ent', '.tld', '.xmi', '.css', '.properties', '.pco'][page_id % 18 + 1]) AS url FROM pages)")
def sc10_language_by_suffix(spark, d):
    made = F.concat("url", F.element_at(F.array(*map(F.lit, (".JS", ".py", ".zzz", ".xml", ".cpy", ".DDL", ".jsp", ".mjs", ".go", ".rb", ".php", ".vm", ".ent", ".tld", ".xmi", ".css", ".properties", ".pco"))), (F.col("page_id") % 18 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", X.language(made).alias("language"))


@query("""WITH b AS (SELECT doc_id, string_split(text, chr(10)) AS l, doc_id % 30 + 1 AS s FROM documents)
    SELECT doc_id, array_to_string(l[greatest(1, s - 8):s + 10], chr(10)) AS slice_text, greatest(1, s - 8) AS from_line FROM b""")
def sc7_slice(spark, d):
    docs = table(spark, d, "documents").withColumn("s", F.col("doc_id") % 30 + 1)
    return docs.select("doc_id", E.source_slice(F.col("text"), F.col("s"), F.col("s") + 2, 8).alias("slice_text"), F.greatest(F.lit(1), F.col("s") - 8).alias("from_line"))


@query("""WITH k AS (SELECT unnest([7, 3, 999999999, 1, 3]) AS doc_id, unnest([0, 1, 2, 3, 4]) AS pos) SELECT pos::BIGINT AS pos, doc_id::BIGINT AS doc_id, n_chars FROM k JOIN documents USING (doc_id) ORDER BY pos""")
def sc9_lookup_in_order(spark, d):
    keys = spark.createDataFrame([(i, k) for i, k in enumerate([7, 3, 999999999, 1, 3])], "pos long, doc_id long")
    return table(spark, d, "documents").select("doc_id", "n_chars").join(F.broadcast(keys), "doc_id").select("pos", "doc_id", "n_chars").orderBy("pos")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (3, 4, 100000000)")
def sc8_point_lookup(spark, d):
    return table(spark, d, "documents").filter(F.col("doc_id").isin(3, 4, 100000000)).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, source, n_chars FROM documents")
def sc3_full_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "n_chars")


@query(r"""WITH e AS (SELECT doc_id, unnest([concat('src/a', doc_id, '.py:', doc_id % 50 + 1, '-', doc_id % 50 + 9, ',', doc_id % 7 + 60), concat('- lib/b.cs:', doc_id % 9 + 1), 'plain/path.sql', 'bad.py:1-x']) AS entry FROM documents)
    SELECT doc_id, concat('src/a', doc_id, '.py') AS path, doc_id % 50 + 1 AS start_line, doc_id % 50 + 9 AS end_line FROM documents
    UNION ALL SELECT doc_id, concat('src/a', doc_id, '.py'), doc_id % 7 + 60, doc_id % 7 + 60 FROM documents UNION ALL SELECT doc_id, 'lib/b.cs', doc_id % 9 + 1, doc_id % 9 + 1 FROM documents
    UNION ALL SELECT doc_id, 'plain/path.sql', 1, 2147483647 FROM documents UNION ALL SELECT doc_id, 'bad.py:1-x', 1, 2147483647 FROM documents UNION ALL SELECT doc_id, 'A.java', 1, 2 FROM documents UNION ALL SELECT doc_id, 'B.java', 5, doc_id % 9 + 5 FROM documents UNION ALL SELECT doc_id, 'B.java', 90, 90 FROM documents""")
def sc6_citations(spark, d):
    n = F.col("doc_id")
    raw = F.concat_ws("\n", F.format_string("* src/a%d.py:%d-%d,%d", n, n % 50 + 1, n % 50 + 9, n % 7 + 60), F.format_string("- lib/b.cs:%d", n % 9 + 1), F.lit("plain/path.sql"), F.lit("bad.py:1-x"), F.format_string("A.java:1-2, B.java:5-%d, 90", n % 9 + 5))
    return E.citations(table(spark, d, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    m AS (SELECT doc_id, line, unnest(regexp_extract_all(t, '([A-Za-z_][A-Za-z0-9_]*) ?[=:] ?["(]', 1)) AS name FROM l)
    SELECT doc_id, line::BIGINT AS line, name, count(*) AS n FROM m GROUP BY ALL""")
def ex2_regex_extract(spark, d):
    found = E.matches_by_line(table(spark, d, "documents"), "doc_id", "text", r'([A-Za-z_][A-Za-z0-9_]*) ?[=:] ?["(]', 1)
    return found.groupBy("doc_id", "line", "name").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT p_partkey, regexp_replace(string_split(concat('[dbo].["', p_name, '"]'), '.')[-1], '^[\["`]+|[\]"`]+$', '', 'g') AS ident FROM part""")
def ex6_ident(spark, d):
    return table(spark, d, "part").select("p_partkey", X.identifier(F.concat(F.lit('[dbo].["'), F.col("p_name"), F.lit('"]'))).alias("ident"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tag FROM pages)
    SELECT page_id, CASE WHEN tag IN ('h1', 'h2', 'title') THEN 'heading' WHEN tag IN ('a', 'img') THEN 'reference' WHEN tag IN ('script', 'style') THEN 'code' ELSE 'has_annotation' END AS predicate, count(*) AS n, 0.9::DOUBLE AS confidence FROM a GROUP BY 1, 2""")
def ex4_facts_by_intent(spark, d):
    intents = {"h1": "heading", "h2": "heading", "title": "heading", "a": "reference", "img": "reference", "script": "code", "style": "code"}
    return E.facts(table(spark, d, "pages"), "page_id", "html", "<([a-z0-9]+)[ >]", intents)


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '~~', 'g') AS t, n_chars % 5 AS k FROM documents), l AS (SELECT *, string_split(t, chr(10)) AS l FROM t)
    SELECT doc_id, CASE WHEN k = 0 AND length(t) >= 20 THEN substr(t, 1, 20) WHEN k IN (0, 1) AND len(l) >= 2 THEN array_to_string(l[1:2], chr(10)) WHEN k = 2 THEN l[1] WHEN k = 3 AND len(l) >= 3 THEN array_to_string(l[2:3], chr(10)) END AS entity FROM l""")
def m17_entity_body(spark, d):
    """Valid offsets, lines only, negative offsets, offsets that are a point, and nothing at all."""
    k = F.col("n_chars") % 5
    pick = lambda *values: F.get(F.array(*(F.lit(v).cast("int") for v in values)), k.cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "~~").alias("t"), pick(0, None, -1, 5, None).alias("a"), pick(20, None, 5, 5, None).alias("b"), pick(1, 1, 1, 2, None).alias("s"), pick(2, 2, 1, 3, None).alias("e"))
    return rows.select("doc_id", E.entity_body(F.col("t"), F.col("a"), F.col("b"), F.col("s"), F.col("e")).alias("entity"))


@query("SELECT 0.9::DOUBLE AS confidence, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|h2|title)[ >]', 1)) AS tag FROM pages) HAVING count(*) > 0")
def ex10_confidence(spark, d):
    """Facts that patterns find, by how sure they are."""
    found = E.facts(table(spark, d, "pages"), "page_id", "html", "<(h1|h2|title)[ >]", {"h1": "heading", "h2": "heading", "title": "heading"})
    return found.groupBy("confidence").agg(F.sum("n").alias("n"))
