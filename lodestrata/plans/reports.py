"""Report queries: counts, facets, fill, pages, joins and set operations over the star tables, documents and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import provenance as V
from ..operators import report as R
from .catalog import query, table


def _labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


_lab = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
def n_rows():
    return F.count(F.lit(1)).alias("n")


def _order():
    return [F.col("prio"), F.desc("o_totalprice"), F.col("o_orderkey")]


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM events) AS events, (SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') FROM documents) AS languages")
def a1_index_stats(spark, d):
    count = lambda t: table(spark, d, t).agg(F.count(F.lit(1)).alias(t))
    langs = table(spark, d, "documents").select("lang").distinct().agg(F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("languages"))
    return count("documents").crossJoin(count("pages")).crossJoin(count("events")).crossJoin(langs)  # four single rows


@query(f"SELECT quality AS value, count(*) AS n FROM {_lab} GROUP BY 1")
def a2_group_null_last(spark, d):
    return R.group_null_last(_labelled(spark, d), "quality")


@query(f"SELECT coalesce(quality::VARCHAR, '(none)') AS value, count(*) AS n FROM {_lab} GROUP BY 1")
def a3_group_coalesce(spark, d):
    return R.group_coalesce(_labelled(spark, d), "quality")


@query(f"SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM {_lab} UNION ALL SELECT 'source', source FROM {_lab} UNION ALL SELECT 'quality', quality::VARCHAR FROM {_lab} UNION ALL SELECT 'toxic', toxic::VARCHAR FROM {_lab}) WHERE value IS NOT NULL GROUP BY 1, 2")
def a4_facets(spark, d):
    return R.facets(_labelled(spark, d), ["lang", "source", "quality", "toxic"])


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_totalprice > 100000) AS big, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus = 'O') AS big_open FROM orders")
def a5_conditional_sums(spark, d):
    c = lambda s, n: F.count_if(F.expr(s)).alias(n)
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), c("o_orderstatus = 'F'", "closed"), c("o_totalprice > 100000", "big"), c("o_orderpriority = '1-URGENT'", "urgent"), c("o_totalprice > 100000 AND o_orderstatus = 'O'", "big_open"))


_fill = f"f AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE source END AS source, quality::VARCHAR AS quality FROM {_lab}), l AS (SELECT 'lang' AS column_name, lang AS v FROM f UNION ALL SELECT 'source', source FROM f UNION ALL SELECT 'quality', quality FROM f), k AS (SELECT column_name, count(*) FILTER (v <> '') AS filled, count(*) FILTER (v = '') AS empty, count(*) FILTER (v IS NULL) AS absent FROM l GROUP BY 1)"


def _fills(spark, d):
    i = F.col("doc_id") % 4
    return R.fill_counts(_labelled(spark, d).withColumn("source", F.when(i == 0, "").when(i != 1, F.col("source"))), ["lang", "source", "quality"])


@query(f"WITH {_fill} SELECT * FROM k")
def a6_fill_counts(spark, d):
    return _fills(spark, d)


@query(f"WITH {_fill} SELECT column_name, round(100.0::DOUBLE * (CASE column_name WHEN 'source' THEN filled + empty ELSE filled END) / nullif(filled + empty + absent, 0), 4) AS rate FROM k")
def a7_fill_rates(spark, d):
    return R.fill_rates(_fills(spark, d), ("source",))


@query("SELECT event_type, count(DISTINCT user_id) FILTER (value > 50) AS users, count(*) AS n, count(DISTINCT user_id) AS all_users FROM events GROUP BY 1")
def a8_distinct_filtered(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("users"), n_rows(), F.count_distinct("user_id").alias("all_users"))


@query("SELECT event_type, count(*) FILTER (value >= 50) AS high, count(*) FILTER (value < 50) AS low FROM events GROUP BY 1")
def a9_pivot(spark, d):
    e = table(spark, d, "events").withColumn("side", F.when(F.col("value") >= 50, "high").when(F.col("value") < 50, "low"))
    return e.groupBy("event_type").pivot("side", ["high", "low"]).agg(F.count(F.lit(1))).na.fill(0, ["high", "low"])


@query("SELECT coalesce(sum(c), 0)::BIGINT AS collapsed FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type HAVING count(*) > 1)")
def a10_collapse(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return c.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("collapsed"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_quantity > 10 AND l_returnflag <> 'R' THEN 1 ELSE 0 END) = count(*)")
def a11_forall(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.coalesce(F.expr("l_quantity > 10 AND l_returnflag <> 'R'"), F.lit(False))).alias("ok")).filter("ok").select("l_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def a14_counts_by_key(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(n_rows())


_files = r"""f AS (SELECT page_id, concat(CASE page_id % 9 WHEN 0 THEN 'skip/' WHEN 1 THEN 'vendor/' WHEN 2 THEN 'gen/' ELSE 'src/' END, page_id, ['.py', '.java', '.zzz', '.pem', '.pdf', '.png', '.tld'][page_id % 7 + 1]) AS path, length(html) AS size_bytes, len(string_split(html, chr(10))) AS line_count,
    CASE WHEN page_id % 7 = 6 THEN concat('<uri>http://', CASE WHEN page_id % 2 = 0 THEN 'my.org' ELSE 'else.net' END, '/x</uri>') ELSE html END AS text FROM pages)"""


def _tree(spark, d):
    """Pages as files of a tree with folders and suffixes of all tiers, some of which state where they come from."""
    i = F.col("page_id")
    folder = F.when(i % 9 == 0, "skip/").when(i % 9 == 1, "vendor/").when(i % 9 == 2, "gen/").otherwise("src/")
    end = F.get(F.array(*map(F.lit, (".py", ".java", ".zzz", ".pem", ".pdf", ".png", ".tld"))), (i % 7).cast("int"))
    text = F.when(i % 7 == 6, F.concat(F.lit("<uri>http://"), F.when(i % 2 == 0, "my.org").otherwise("else.net"), F.lit("/x</uri>"))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.concat(folder, i.cast("string"), end).alias("path"), F.length("html").cast("long").alias("size_bytes"), F.size(F.split("html", "\n")).cast("long").alias("line_count"), text.alias("text"))


@query(f"""WITH {_files}, t AS (SELECT size_bytes, line_count, CASE WHEN path LIKE '%.pem' THEN 'credential' WHEN path NOT LIKE 'src/%' AND path LIKE '%.pdf' THEN 'referenced_content' WHEN path NOT LIKE 'src/%' AND path LIKE '%.png' THEN 'asset'
    WHEN path LIKE 'gen/%' THEN 'first_party_excluded' WHEN path NOT LIKE 'src/%' OR regexp_matches(path, '(zzz|pdf|png)$') OR size_bytes > 900 THEN 'gap' ELSE 'indexed' END AS tier FROM f WHERE path NOT LIKE 'skip/%')
    SELECT tiers.tier, count(t.tier) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS size_bytes, coalesce(sum(line_count), 0)::BIGINT AS line_count FROM (SELECT unnest(['indexed', 'credential', 'referenced_content', 'asset', 'first_party_excluded', 'gap']) AS tier) tiers LEFT JOIN t ON t.tier = tiers.tier GROUP BY 1""")
def sc2_tiers(spark, d):
    return V.tier_totals(V.tiered(_tree(spark, d), ["src/**"], ["skip/"], ["gen/**"], 900))


@query("SELECT regexp_extract(url, '([a-z]+)(/|[?#]|$)', 1) AS suffix, count(*) AS n FROM pages GROUP BY 1")
def a18_suffix_histogram(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "([a-z]+)(/|[?#]|$)", 1).alias("suffix")).agg(n_rows())


@query("SELECT event_type AS provenance, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM events")
def a20_provenance_total(spark, d):
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("provenance")).agg(n_rows())
    return by.unionByName(by.agg(F.lit("total").alias("provenance"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


@query("SELECT event_type, value >= 50 AS evaluated, count(*) AS n, event_type = 'error' AND value >= 50 AS blocking FROM events GROUP BY 1, 2, 4")
def a21_findings_tally(spark, d):
    e = table(spark, d, "events").groupBy("event_type", (F.col("value") >= 50).alias("evaluated")).agg(n_rows())
    return e.withColumn("blocking", (F.col("event_type") == "error") & F.col("evaluated"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 100")
def f1_optional_filters(spark, d):
    return R.filtered(table(spark, d, "orders"), 100, "o_orderkey", o_orderstatus="F", o_orderpriority="2-HIGH", o_custkey=None).select("o_orderkey", "o_totalprice")


_list = """o AS (SELECT * FROM orders o WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')),
    l AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey, items, returned, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 9 END AS prio, o_totalprice FROM o JOIN l ON l_orderkey = o_orderkey)"""


def _listed(spark, d):
    """Filtered parents with the counts of their children, both from one aggregate over the children."""
    o = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isNotNull())
    kids = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    prio = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(9)
    return o.join(kids.filter("returned > 0"), "o_orderkey").select("o_orderkey", "items", "returned", prio.alias("prio"), "o_totalprice")


@query(f"WITH {_list} SELECT o_orderkey, items, returned, prio, o_totalprice FROM s ORDER BY prio, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25")
def f2_list_page(spark, d):
    return R.page(_listed(spark, d), _order(), 2)


@query(f"""WITH {_list} SELECT o_orderkey AS gr_id, CASE prio WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'P2' END AS priority, returned AS errors, CASE o_orderkey % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS confidence_extraction, concat('n', o_orderkey % 97) AS name, concat('s', o_orderkey % 5) AS subject FROM s""")
def s1_named_order(spark, d):
    k, prio = F.col("o_orderkey"), F.col("prio")
    rows = _listed(spark, d).select(
        k.alias("gr_id"), F.when(prio == 0, "P0").when(prio == 1, "P1").otherwise("P2").alias("priority"), F.col("returned").alias("errors"), F.when(k % 3 == 0, "Low").when(k % 3 == 1, "Medium").otherwise("High").alias("confidence_extraction"),
        F.concat(F.lit("n"), k % 97).alias("name"), F.concat(F.lit("s"), k % 5).alias("subject"),
    )
    return R.in_order(rows, "priority")


@query(f"WITH {_list} SELECT count(*) AS total, ceil(count(*) / 25)::BIGINT AS pages FROM s")
def l2_page_total(spark, d):
    return _listed(spark, d).agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / 25).cast("long"))


@query(f"SELECT doc_id, quality FROM {_lab} ORDER BY quality DESC NULLS LAST, doc_id")
def s2_nulls_last(spark, d):
    return _labelled(spark, d).select("doc_id", "quality").orderBy(F.desc_nulls_last("quality"), "doc_id")


@query("SELECT page_id, url FROM pages ORDER BY length(url) DESC, url, page_id")
def s3_longest_first(spark, d):
    return table(spark, d, "pages").orderBy(F.desc(F.length("url")), "url", "page_id").select("page_id", "url")


@query("SELECT event_id, concat(event_type, ':', event_id % 100) AS span FROM events ORDER BY event_type, event_id % 100, event_id")
def s4_numeric_span_sort(spark, d):
    span = F.concat_ws(":", "event_type", F.col("event_id") % 100)
    rows = table(spark, d, "events").select("event_id", span.alias("span"))
    return rows.orderBy(F.substring_index("span", ":", 1), F.substring_index("span", ":", -1).cast("int"), "event_id")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%' AND NOT EXISTS (SELECT 1 FROM part WHERE p_name = 'a') ORDER BY p_name, p_partkey LIMIT 50")
def f3_name_search(spark, d):
    return R.by_name(table(spark, d, "part"), "p_name", "a", "p_partkey").select("p_partkey", "p_name")


@query("SELECT event_id, event_type, props FROM events WHERE event_type = 'click' AND user_id = 3")
def f6_facts_by_subject(spark, d):
    return R.filtered(table(spark, d, "events"), event_type="click", user_id=3).select("event_id", "event_type", "props")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(p, '^(.*/)?en/') THEN NULL WHEN regexp_matches(p, '^m\.[^/]*') THEN 'm.*' WHEN regexp_matches(p, '^(.*/)?fr/') THEN '**/fr/**' END AS deciding FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def f7_last_glob(spark, d):
    from ..functions.text import last_glob

    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, d, "pages").select("page_id", last_glob(path, ["fr/**", "**/fr/**", "m.*", "!**/en/**"]).alias("deciding"))


@query(f"""WITH {_files}, s AS (SELECT page_id, path, nullif(regexp_extract(text, '<uri>([^<]+)</uri>', 1), '') AS said FROM f), o AS (SELECT *, CASE WHEN path LIKE '%.tld' THEN said END AS stated FROM s)
    SELECT page_id, CASE WHEN stated IS NOT NULL THEN CASE WHEN NOT contains(stated, 'my.org') THEN 'declared_identity' END WHEN regexp_matches(path, '3[.]java$') THEN 'vendor_filename' WHEN path LIKE 'vendor/%' THEN 'vendored_globs' END AS rule,
    CASE WHEN stated IS NOT NULL THEN CASE WHEN NOT contains(stated, 'my.org') THEN stated END WHEN regexp_matches(path, '3[.]java$') THEN '3[.]java$' WHEN path LIKE 'vendor/%' THEN 'vendor/' END AS detail, coalesce(contains(stated, 'my.org'), false) AND path LIKE 'vendor/%' AS rescued FROM o""")
def f8_third_party(spark, d):
    return V.third_party(_tree(spark, d), ["my.org"], ["3[.]java$"], ["vendor/"]).select("page_id", "rule", "detail", "rescued")


_gr = "g AS (SELECT o_orderkey AS gr_id, CASE o_orderkey % 3 WHEN 0 THEN 'behavioral' WHEN 1 THEN 'definitional' END AS rule_class, CASE o_custkey % 4 WHEN 0 THEN 'B-COND' WHEN 1 THEN 'D-NEC' END AS pattern, ['draft', 'approved', 'odd'][o_custkey % 3 + 1] AS state, CASE WHEN o_orderkey % 5 = 0 THEN 'delegated' END AS disposition, CASE WHEN o_orderkey % 2 = 0 THEN 'strict' END AS enforcement_level, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS statement FROM orders)"


@query(f"""WITH {_gr} SELECT gr_id, 'statement' AS column_name, 'is empty' AS reason FROM g WHERE statement IS NULL UNION ALL SELECT gr_id, 'state', 'has a value that is not allowed' FROM g WHERE state = 'odd'
    UNION ALL SELECT gr_id, 'enforcement_level', 'a definitional rule cannot have one' FROM g WHERE rule_class = 'definitional' AND enforcement_level IS NOT NULL UNION ALL SELECT gr_id, 'pattern', 'is of the other class' FROM g WHERE (rule_class = 'behavioral' AND pattern LIKE 'D-%') OR (rule_class = 'definitional' AND pattern LIKE 'B-%')
    UNION ALL SELECT gr_id, 'pattern', 'an approved rule needs one' FROM g WHERE state = 'approved' AND pattern IS NULL AND disposition IS NULL""")
def f10_violations(spark, d):
    from ..operators.store import violations

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        k.alias("gr_id"), F.when(k % 3 == 0, "behavioral").when(k % 3 == 1, "definitional").alias("rule_class"), F.when(c % 4 == 0, "B-COND").when(c % 4 == 1, "D-NEC").alias("pattern"), F.when(c % 3 == 0, "draft").when(c % 3 == 1, "approved").otherwise("odd").alias("state"),
        F.when(k % 5 == 0, "delegated").alias("disposition"), F.when(k % 2 == 0, "strict").alias("enforcement_level"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("statement"),
    )
    return violations(rows, "gr_id", ["statement"], {"state": ["draft", "approved", "reviewed"]})


@query(f"SELECT doc_id, quality IS NOT DISTINCT FROM toxic AS unedited FROM {_lab}")
def f11_null_safe(spark, d):
    return _labelled(spark, d).select("doc_id", F.col("quality").eqNullSafe(F.col("toxic")).alias("unedited"))


@query("SELECT n_nationkey, lower(trim(n_name)) <> lower(trim(r_name)) AS diverges FROM nation JOIN region ON n_regionkey = r_regionkey")
def f12_divergence(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", (F.lower(F.trim("n_name")) != F.lower(F.trim("r_name"))).alias("diverges"))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j1_semi_batched(spark, d):
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(keys, "o_custkey", "left_semi")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT event_id, coalesce(c_mktsegment, 'unassigned') AS domain FROM events LEFT JOIN customer ON user_id = c_custkey")
def j8_left_unassigned(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return table(spark, d, "events").select("event_id", "user_id").join(c, "user_id", "left").select("event_id", F.coalesce("c_mktsegment", F.lit("unassigned")).alias("domain"))


@query(f"SELECT doc_id, source FROM {_lab} WHERE quality IS NULL")
def j10_unhashed(spark, d):
    return _labelled(spark, d).filter("quality IS NULL").select("doc_id", "source")


@query("SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j12_domain_counts(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows())
    return table(spark, d, "customer").join(per, "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("n_orders"))


_pairs = "(SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"


def _nation_pairs(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    other = n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return n.withColumnRenamed("n_nationkey", "a").join(other, "n_regionkey").filter("a < b").select("a", "b")


@query(f"SELECT p.a, p.b, x.n_name AS a_name, y.n_name AS b_name FROM {_pairs} p JOIN nation x ON x.n_nationkey = p.a JOIN nation y ON y.n_nationkey = p.b")
def j13_pairs(spark, d):
    name = lambda k: table(spark, d, "nation").select(F.col("n_nationkey").alias(k), F.col("n_name").alias(f"{k}_name"))
    return _nation_pairs(spark, d).join(name("a"), "a").join(name("b"), "b").select("a", "b", "a_name", "b_name")


@query(f"SELECT a AS me, b AS other FROM {_pairs} UNION ALL SELECT b, a FROM {_pairs}")
def j14_symmetric(spark, d):
    p = _nation_pairs(spark, d)
    return p.select(F.col("a").alias("me"), F.col("b").alias("other")).unionByName(p.select(F.col("b").alias("me"), F.col("a").alias("other")))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS gr_id, l_partkey AS anchor FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 2)
    SELECT DISTINCT gr_id, CASE WHEN p_size % 3 = 0 THEN 'uses_table' WHEN p_size % 3 = 1 THEN 'executes_sql' ELSE 'foreign_key' END AS kind, coalesce(s_name, '(unresolved)') AS store FROM a JOIN part ON p_partkey = anchor LEFT JOIN supplier ON s_suppkey = p_size""")
def j15_dataflow(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gr_id"), F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    anchors = line.filter("l_linenumber = 1").drop("l_linenumber").union(line.filter("l_linenumber <= 2").drop("l_linenumber")).distinct()
    s = F.col("p_size") % 3
    parts = table(spark, d, "part").select("p_partkey", "p_size", F.when(s == 0, "uses_table").when(s == 1, "executes_sql").otherwise("foreign_key").alias("kind"))
    stores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_size"), "s_name")
    return anchors.join(parts, "p_partkey").join(stores, "p_size", "left").select("gr_id", "kind", F.coalesce("s_name", F.lit("(unresolved)")).alias("store")).distinct()


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(flatten(list([p_brand, p_type])))), '|') AS terms FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j16_leaked_terms(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.array("p_brand", "p_type")).alias("term"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms"))


@query("SELECT count(*) AS n, min(c_custkey) AS first_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j18_not_in(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").agg(n_rows(), F.min("c_custkey").alias("first_id"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_closed FROM customer")
def j19_correlated_counts(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_closed"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0, ["n_orders", "n_closed"])


@query("SELECT doc_id, vec_id, source AS domain FROM documents JOIN embeddings ON doc_id = vec_id WHERE source <> 'src0'")
def j20_stamp_domains(spark, d):
    docs = table(spark, d, "documents").filter("source != 'src0'").select("doc_id", F.col("source").alias("domain"))
    return docs.join(table(spark, d, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "vec_id", "domain")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS wide FROM documents ORDER BY wide LIMIT 200), f AS (SELECT doc_id, wide, row_number() OVER (ORDER BY wide) AS rank FROM r WHERE lang = 'fr') SELECT * FROM f")
def w2_filter_then_rank(spark, d):
    order = [F.desc("n_chars"), F.col("doc_id")]
    top = R.numbered(table(spark, d, "documents").select("doc_id", "lang", "n_chars").orderBy(*order).limit(200), order, "wide")
    return R.numbered(top.filter("lang = 'fr'"), [F.col("wide")]).select("doc_id", "wide", "rank")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS i FROM events) WHERE i = 1")
def w5_first_per_key(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_id, row_number() OVER w AS ordinal, lag(event_id) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)")
def w6_event_order(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("ordinal"), F.lag("event_id").over(w).alias("previous"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def l1_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def u1_union(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def u3_difference(spark, d):
    gone = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(gone, "p_partkey", "left_anti")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def u4_intersection(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "events").select("user_id"))


@query("SELECT DISTINCT lang, source FROM documents")
def u5_distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def sk2_orphans_dropped(spark, d):
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").select("event_id", "user_id").join(known, "user_id", "left_semi").select("event_id", "user_id")


@query("""WITH k AS (SELECT l_orderkey, array_to_string(list_sort(list(concat(l_linenumber, ':', l_partkey))), ',') AS before, array_to_string(list_sort(list(concat(l_linenumber, ':', CASE WHEN l_orderkey % 9 = 0 THEN l_partkey + 1 ELSE l_partkey END))), ',') AS after FROM lineitem GROUP BY 1)
    SELECT l_orderkey FROM k WHERE before IS DISTINCT FROM after""")
def sk4_changed_children(spark, d):
    kids = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = F.when(F.col("l_orderkey") % 9 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    sides = kids.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("before"), F.array_sort(F.collect_list(F.struct("l_linenumber", new.alias("l_partkey")))).alias("after"))
    return sides.filter(~F.col("before").eqNullSafe(F.col("after"))).select("l_orderkey")


@query("SELECT coalesce(source, 'none') AS tier, count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS total_chars, coalesce(sum(len(string_split(text, chr(10)))), 0)::BIGINT AS total_lines FROM documents GROUP BY 1")
def a17_tier_totals(spark, d):
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("tier"), "n_chars", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).alias("lines"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), total("n_chars").alias("total_chars"), total("lines").alias("total_lines"))


@query("SELECT l_orderkey, l_linenumber, p_brand AS path FROM lineitem JOIN part ON l_partkey = p_partkey")
def j2_refs_with_files(spark, d):
    files = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(files, "l_partkey").drop("l_partkey")
