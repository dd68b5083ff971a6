"""Requirement-store queries on analogues: events as offers and rows, orders and line items as parents and children."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import report as R
from ..operators import store as S
from ..tables import written
from .catalog import query, table

_off = "o AS (SELECT event_id AS ordinal, concat(user_id, '/', event_type, '/', event_id % 7) AS dk, concat(user_id, '/', event_id % 5) AS dka FROM events WHERE event_id % 4 <> 0), st AS (SELECT concat('g', event_id) AS gr_id, concat(user_id, '/', event_type, '/', event_id % 7) AS dk, concat(user_id, '/', event_id % 5) AS dka FROM events WHERE event_id % 40 = 0)"
_lines = "concat('f', event_id % 97) AS path, event_id * 7919 % 2000 AS start_line, event_id * 7919 % 2000 + event_id % 3 AS end_line"
_out = f"""{_off}, b AS (SELECT *, min(ordinal) OVER (PARTITION BY dk) AS first, (SELECT min(gr_id) FROM st WHERE st.dk = o.dk) AS sid FROM o),
    c AS (SELECT *, sid IS NULL AND first = ordinal AS ins, coalesce(sid, first::VARCHAR) AS gr_ref FROM b),
    e AS (SELECT *, coalesce(sum(ins::INT) OVER (PARTITION BY dka ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 OR EXISTS (SELECT 1 FROM st WHERE st.dka = c.dka) AS drift FROM c),
    r AS (SELECT ordinal, dka, CASE WHEN NOT ins THEN 'merged' WHEN drift THEN 'candidate' ELSE 'new' END AS outcome, gr_ref FROM e),
    dp AS (SELECT DISTINCT r.ordinal, x.other FROM r JOIN (SELECT dka, NULL AS at_, gr_id AS other FROM st UNION ALL SELECT dka, ordinal, gr_ref FROM r WHERE outcome <> 'merged') x ON x.dka = r.dka WHERE outcome = 'candidate' AND (at_ IS NULL OR at_ < ordinal)),
    ct AS (SELECT event_id AS ordinal, {_lines} FROM events WHERE event_id % 4 <> 0),
    oc AS (SELECT concat('g', event_id) AS other, NULL AS at_, {_lines} FROM events WHERE event_id % 40 = 0 UNION ALL SELECT gr_ref, ordinal, path, start_line, end_line FROM ct JOIN r USING (ordinal)),
    op AS (SELECT DISTINCT a.ordinal, oc.other FROM ct a JOIN r USING (ordinal) JOIN oc ON oc.path = a.path AND a.start_line <= oc.end_line AND a.end_line >= oc.start_line WHERE outcome = 'new' AND oc.other <> gr_ref AND (at_ IS NULL OR at_ < a.ordinal)),
    sp AS (SELECT event_id AS ordinal, concat('g', event_id // 40 * 40) AS other, round(1 / (1 + event_id % 10 / 10.0::DOUBLE), 6) AS similarity FROM events WHERE event_id % 11 = 0 AND event_id % 4 <> 0),
    pr AS (SELECT ordinal, other, 'drift' AS reason, NULL::DOUBLE AS similarity FROM dp UNION ALL SELECT ordinal, other, 'overlap', NULL FROM op UNION ALL SELECT ordinal, other, 'semantic', similarity FROM sp JOIN r USING (ordinal) WHERE outcome = 'new' AND other <> gr_ref),
    fin AS (SELECT ordinal, CASE WHEN outcome = 'new' AND ordinal IN (SELECT ordinal FROM pr) THEN 'candidate' ELSE outcome END AS outcome, gr_ref FROM r)"""


def _offers(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.concat_ws("/", "user_id", "event_type", e % 7).alias("dk"), F.concat_ws("/", "user_id", e % 5).alias("dka"))
    return rows.filter("event_id % 4 != 0").withColumnRenamed("event_id", "ordinal"), rows.filter("event_id % 40 = 0").select(F.concat(F.lit("g"), "event_id").alias("gr_id"), "dk", "dka")


def _stage_one(spark, d):
    """Stage one, written once, and the stored rows."""
    offers, stored = _offers(spark, d)
    return written(M.outcomes(offers, stored)), stored


def _cited_lines(spark, d):
    """Citations of offers and stored rows, and what is near by meaning."""
    e = F.col("event_id")
    lines = table(spark, d, "events").select("event_id", F.concat(F.lit("f"), e % 97).alias("path"), (e * 7919 % 2000).alias("start_line"), (e * 7919 % 2000 + e % 3).alias("end_line"))
    cites, stored = lines.filter("event_id % 4 != 0").withColumnRenamed("event_id", "ordinal"), lines.filter("event_id % 40 = 0").withColumn("gr_id", F.concat(F.lit("g"), "event_id"))
    near = table(spark, d, "events").filter("event_id % 11 = 0 AND event_id % 4 != 0").select(e.alias("ordinal"), F.concat(F.lit("g"), (F.floor(e / 40) * 40).cast("string")).alias("other"), F.round(1 / (1 + e % 10 / 10.0), 6).alias("similarity"))
    return cites, stored, near


@query(f"WITH {_out} SELECT ordinal, outcome, gr_ref FROM fin")
def m3_merge_outcomes(spark, d):
    found, _ = _stage_one(spark, d)
    return M.merge_outcomes(found, M.second_stage(found, *_cited_lines(spark, d)))


@query(f"WITH {_out} SELECT ordinal, other, reason, similarity FROM pr")
def m3_pairs(spark, d):
    found, stored = _stage_one(spark, d)
    return M.merge_pairs(found, stored, *_cited_lines(spark, d))


@query(f"WITH {_out} SELECT ordinal, other FROM dp")
def m3_drift_pairs(spark, d):
    return M.drift_pairs(*_stage_one(spark, d))


@query(f"WITH {_out} SELECT outcome, count(*) AS n FROM fin GROUP BY 1")
def a18_outcome_tally(spark, d):
    return m3_merge_outcomes(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT o_orderkey AS gr_id, o_orderstatus AS category, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderpriority END AS statement, CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE o_orderpriority END AS statement_extracted, o_custkey AS reviewer FROM orders),
    i AS (SELECT o_orderkey AS gr_id, CASE o_orderkey % 2 WHEN 0 THEN o_orderstatus ELSE 'N' END AS category, concat(o_orderpriority, '!') AS statement FROM orders WHERE o_orderkey % 4 <> 0),
    n AS (SELECT e.gr_id, CASE WHEN i.gr_id IS NOT NULL THEN i.category ELSE e.category END AS category, CASE WHEN i.gr_id IS NOT NULL AND e.statement IS NOT DISTINCT FROM e.statement_extracted THEN i.statement ELSE e.statement END AS statement, CASE WHEN i.gr_id IS NOT NULL THEN i.statement ELSE e.statement_extracted END AS statement_extracted, e.reviewer,
        e.category AS c0, e.statement AS s0, e.statement_extracted AS x0 FROM e LEFT JOIN i ON e.gr_id = i.gr_id)
    SELECT gr_id, category, statement, statement_extracted, reviewer, (category IS DISTINCT FROM c0 OR statement IS DISTINCT FROM s0 OR statement_extracted IS DISTINCT FROM x0) AS changed FROM n""")
def m4_field_merge(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    pr = F.col("o_orderpriority")
    existing = o.select(k.alias("gr_id"), F.col("o_orderstatus").alias("category"), F.when(k % 3 != 0, pr).alias("statement"), F.when(k % 5 == 0, "x").when(k % 5 != 1, pr).alias("statement_extracted"), F.col("o_custkey").alias("reviewer"))
    incoming = o.filter(k % 4 != 0).select(k.alias("gr_id"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("N").alias("category"), F.concat(pr, F.lit("!")).alias("statement"))
    return M.merged_fields(existing, incoming, "gr_id", ["category"], ["statement"], ["reviewer"])


@query("""WITH s AS (SELECT user_id AS existing_id, event_id % 50 AS incoming_id, max(value) AS old, CASE WHEN min(event_id) % 3 = 0 THEN 'accepted' ELSE 'unresolved' END AS res FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
    i AS (SELECT user_id AS existing_id, event_id % 50 AS incoming_id, min(value) AS new FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
    SELECT coalesce(s.existing_id, i.existing_id) AS existing_id, coalesce(s.incoming_id, i.incoming_id) AS incoming_id, CASE WHEN coalesce(res, 'unresolved') = 'unresolved' AND new IS NOT NULL THEN new ELSE old END AS similarity, coalesce(res, 'unresolved') AS resolution
    FROM s FULL JOIN i ON s.existing_id = i.existing_id AND s.incoming_id = i.incoming_id""")
def m5_candidate_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("existing_id"), (F.col("event_id") % 50).alias("incoming_id"), "event_id", "value")
    stored = e.filter("event_id % 2 = 0").groupBy("existing_id", "incoming_id").agg(F.max("value").alias("similarity"), F.when(F.min("event_id") % 3 == 0, "accepted").otherwise("unresolved").alias("resolution"))
    return M.candidate_upsert(stored, e.filter("event_id % 3 = 0").groupBy("existing_id", "incoming_id").agg(F.min("value").alias("similarity")))


_states = "['draft', 'reviewed', 'approved', 'rejected', 'superseded']"
_legal = "concat(old, '>', new) IN ('draft>reviewed', 'draft>approved', 'draft>rejected', 'reviewed>approved', 'reviewed>rejected', 'reviewed>draft', 'approved>superseded', 'approved>rejected', 'rejected>draft')"


@query(f"""WITH c AS (SELECT o_orderkey AS id, {_states}[o_orderkey % 5 + 1] AS old, {_states}[o_custkey % 5 + 1] AS new, CASE WHEN o_orderkey % 7 <> 0 THEN 'p' END AS pattern FROM orders),
    b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
    SELECT id, CASE WHEN NOT {_legal} THEN 'illegal' WHEN new = 'approved' AND (pattern IS NULL OR id IN (SELECT id FROM b)) THEN 'blocked' ELSE 'ok' END AS verdict FROM c""")
def m7_transitions(spark, d):
    states = F.array(*map(F.lit, ("draft", "reviewed", "approved", "rejected", "superseded")))
    k = F.col("o_orderkey")
    changes = table(spark, d, "orders").select(k.alias("id"), F.get(states, (k % 5).cast("int")).alias("old"), F.get(states, (F.col("o_custkey") % 5).cast("int")).alias("new"), F.when(k % 7 != 0, "p").alias("pattern"))
    blocking = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return M.transitions(changes, blocking)


@query(f"""WITH i AS (SELECT o_orderkey AS gr_id, {_states[:-1]}, 'unheard of'][o_orderkey % 6 + 1] AS state, 'new' AS reviewer, o_totalprice AS price FROM orders), s AS (SELECT o_orderkey AS gr_id, {_states}[o_custkey % 5 + 1] AS state, o_orderpriority AS reviewer FROM orders WHERE o_orderkey % 3 <> 0),
    r AS (SELECT i.*, s.state AS s1, s.reviewer AS r1, coalesce((CASE i.state WHEN 'reviewed' THEN 1 WHEN 'approved' THEN 2 WHEN 'superseded' THEN 3 ELSE 0 END) < (CASE s.state WHEN 'reviewed' THEN 1 WHEN 'approved' THEN 2 WHEN 'superseded' THEN 3 WHEN 'draft' THEN 0 WHEN 'rejected' THEN 0 END), false) AS guarded FROM i LEFT JOIN s ON i.gr_id = s.gr_id)
    SELECT gr_id, CASE WHEN guarded THEN s1 ELSE state END AS state, CASE WHEN guarded THEN r1 ELSE reviewer END AS reviewer, price, guarded FROM r""")
def m8_downgrade_guard(spark, d):
    states = F.array(*map(F.lit, ("draft", "reviewed", "approved", "rejected", "superseded")))
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    incoming = o.select(k.alias("gr_id"), F.coalesce(F.get(states, (k % 6).cast("int")), F.lit("unheard of")).alias("state"), F.lit("new").alias("reviewer"), F.col("o_totalprice").alias("price"))
    stored = o.filter(k % 3 != 0).select(k.alias("gr_id"), F.get(states, (F.col("o_custkey") % 5).cast("int")).alias("state"), F.col("o_orderpriority").alias("reviewer"))
    return M.import_guard(stored, incoming, "gr_id", ["reviewer"], ["price"])


def _cited(spark, d):
    """Events as citations: a user is a requirement, the kind of an event its domain; some users cite nothing but sentinels."""
    e = table(spark, d, "events")
    domain = F.when(F.col("user_id") % 13 == 0, "unassigned").when(F.col("user_id") % 13 == 1, F.when(F.col("event_id") % 2 == 0, "excluded").otherwise("unassigned")).when((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0), "unassigned").otherwise(F.col("event_type"))
    return e.select("user_id", domain.alias("domain"))


def _stated(spark, d):
    u = F.col("user_id")
    text = F.format_string("The clerk %d must act.", u)
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", text.alias("statement"), F.lit("behavioral").alias("rule_class"), F.when(u % 3 != 0, "B-UNCOND").alias("pattern"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("enforcement_level"), F.lit(None).cast("array<string>").alias("terms"))


_subject = """ci AS (SELECT user_id, CASE WHEN user_id % 13 = 0 THEN 'unassigned' WHEN user_id % 13 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'excluded' ELSE 'unassigned' END WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'unassigned' ELSE event_type END AS v FROM events),
    cn AS (SELECT user_id, v, count(*) AS c FROM ci GROUP BY 1, 2), tt AS (SELECT user_id, coalesce(sum(c) FILTER (v NOT IN ('unassigned', 'excluded')), 0) AS total, max(c) FILTER (v NOT IN ('unassigned', 'excluded')) AS top, bool_and(v = 'unassigned') AS alone FROM cn GROUP BY 1),
    su AS (SELECT user_id, CASE WHEN top * 2 > total THEN (SELECT min(v) FROM cn WHERE cn.user_id = tt.user_id AND cn.c = tt.top AND v NOT IN ('unassigned', 'excluded')) WHEN user_id % 3 <> 0 THEN concat('The clerk ', user_id) END AS subject,
        CASE WHEN top * 2 > total THEN 'derived' WHEN alone THEN 'llm_named' ELSE 'derived_ambiguous' END AS subject_provenance FROM tt)"""


@query(f"WITH {_subject} SELECT user_id, subject, subject_provenance FROM su")
def a12_subject(spark, d):
    return R.derive_subject(_cited(spark, d), _stated(spark, d), "user_id")


@query("""WITH o AS (SELECT doc_id, lang AS old FROM documents), n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'en' ELSE lang END AS new FROM documents)
    SELECT old, new, count(*) AS n FROM o JOIN n USING (doc_id) WHERE old IS DISTINCT FROM new GROUP BY 1, 2""")
def a19_transitions(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("old"), F.when(F.col("doc_id") % 6 == 0, "en").otherwise(F.col("lang")).alias("new"))
    return docs.filter(~F.col("old").eqNullSafe(F.col("new"))).groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Given.' ELSE concat_ws(' ', coalesce(nullif(trim(a), ''), nullif(trim(p), ''), 'This rule'), CASE doc_id % 3 WHEN 1 THEN 'always' ELSE 'must' END, coalesce(nullif(trim(t), ''), nullif(trim(p), ''), 'be reviewed')) END AS statement
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  ' ELSE source END AS a, CASE doc_id % 5 WHEN 0 THEN lang END AS p, CASE doc_id % 7 WHEN 0 THEN 'apply ' END AS t FROM documents)""")
def m14_statement(spark, d):
    i = F.col("doc_id")
    made = S.statement(F.when(i % 4 == 0, "Given.").when(i % 4 == 1, " "), F.when(i % 3 == 0, "  ").otherwise(F.col("source")), F.when(i % 5 == 0, F.col("lang")), F.when(i % 7 == 0, "apply "), F.when(i % 3 == 1, "definitional").when(i % 3 == 2, "behavioral"))
    return table(spark, d, "documents").select("doc_id", made.alias("statement"))


@query("SELECT event_id, CASE WHEN event_type <> 'view' AND event_id % 3 = 0 THEN event_id % 4 END AS not_accounted_for, coalesce(event_type <> 'view' AND event_id % 3 = 0 AND event_id % 4 = 0, false) AS complete FROM events")
def m15_run_coverage(spark, d):
    """Payloads with a whole number, a text (of digits, too) or nothing as uncovered, some of them skipped."""
    e = F.col("event_id")
    payload = F.when(e % 3 == 0, F.format_string('{"coverage": {"uncovered": %d, "skipped": %s}}', e % 4, F.when(F.col("event_type") == "view", "true").otherwise("false"))).when(e % 6 == 1, '{"coverage": {"uncovered": "many"}}').when(e % 6 == 4, '{"coverage": {"uncovered": "5"}}')
    return M.run_coverage(table(spark, d, "events").select("event_id", payload.alias("payload")), "event_id", "payload")


@query("""SELECT DISTINCT l_suppkey AS run_id, CASE WHEN l_suppkey % 4 = 0 THEN 'coverage not measured — completeness unknown' ELSE concat(l_suppkey % 4 - 1, ' chunks unaccounted for') END AS reason
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_suppkey % 4 <> 1 AND l_suppkey % 5 <> 0""")
def m9_export_gate(spark, d):
    """Finished orders as rows to export, suppliers as runs that gave them."""
    k = F.col("s_suppkey")
    runs = table(spark, d, "supplier").select(k.alias("run_id"), F.when(k % 4 != 0, k % 4 - 1).alias("not_accounted_for"), (k % 5 == 0).alias("gate_excluded"))
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("gr_id"))
    return S.blocking_runs(rows, table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("gr_id")), runs)


@query("""WITH k AS (SELECT l_orderkey, to_json(list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_returnflag': l_returnflag} ORDER BY l_linenumber, l_partkey, l_returnflag)) AS j FROM lineitem GROUP BY 1)
    SELECT o_orderkey, concat('{"items":', coalesce(j, '[]'), ',"o_custkey":', o_custkey, ',"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '"}') AS line FROM orders LEFT JOIN k ON l_orderkey = o_orderkey""")
def sk5_nested_export(spark, d):
    parents = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag")
    return M.export_jsonl(parents, kids, "o_orderkey", ["l_linenumber"], ["l_linenumber", "l_partkey", "l_returnflag"], "items")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_nationkey, -1.0 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 100000000, c_nationkey, -1.0 FROM customer WHERE c_custkey % 50 = 0")
def sk1_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(-1.0))
    more = c.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 100000000).alias("c_custkey"), "c_nationkey", F.lit(-1.0).alias("c_acctbal"))
    return R.upsert(c, new.unionByName(more), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sk3_cascade(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.cascade(table(spark, d, "lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT user_id AS gr_id, event_id % 40 AS line, min(event_type) AS hash FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), i AS (SELECT user_id AS gr_id, event_id % 40 AS line, max(event_type) AS hash FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
    SELECT coalesce(s.gr_id, i.gr_id) AS gr_id, coalesce(s.line, i.line) AS line, coalesce(i.hash, s.hash) AS hash, (s.gr_id IS NULL OR (i.gr_id IS NOT NULL AND i.hash <> s.hash)) AS moved FROM s FULL JOIN i ON s.gr_id = i.gr_id AND s.line = i.line""")
def m6_citation_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("gr_id"), (F.col("event_id") % 40).alias("line"), "event_id", "event_type")
    stored = e.filter("event_id % 2 = 0").groupBy("gr_id", "line").agg(F.min("event_type").alias("old"))
    incoming = e.filter("event_id % 3 = 0").groupBy("gr_id", "line").agg(F.max("event_type").alias("new"))
    both = stored.join(incoming, ["gr_id", "line"], "full_outer")
    moved = F.col("old").isNull() | F.coalesce(F.col("new") != F.col("old"), F.lit(False))
    return both.select("gr_id", "line", F.coalesce("new", "old").alias("hash"), moved.alias("moved"))


@query(f"WITH {_subject}, o AS (SELECT user_id, max_by(event_type, event_id) AS old_subject, CASE WHEN user_id % 2 = 0 THEN 'derived' ELSE 'llm_named' END AS old_provenance FROM events GROUP BY 1) SELECT user_id, old_subject, old_provenance, subject, subject_provenance FROM o JOIN su USING (user_id) WHERE old_subject IS DISTINCT FROM subject OR old_provenance IS DISTINCT FROM subject_provenance")
def m10_rederive_changed(spark, d):
    stored = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("subject"), F.when(F.col("user_id") % 2 == 0, "derived").otherwise("llm_named").alias("subject_provenance"))
    return R.rederived(stored, _cited(spark, d), _stated(spark, d), "user_id")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'retired' END ELSE o_orderstatus END AS state FROM orders")
def m12_set_field(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state"))
    edits = o.filter("o_custkey % 11 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "retired").alias("value"))
    return S.set_field(o, "o_orderkey", "state", edits).select("o_orderkey", "state")


@query("SELECT s_suppkey AS run_id, s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 AS gate_excluded, CASE WHEN s_suppkey % 4 = 0 THEN concat('old run of ', s_name) WHEN s_suppkey % 3 = 0 THEN 'first' END AS gate_excluded_reason FROM supplier")
def m12_retire_runs(spark, d):
    k = F.col("s_suppkey")
    runs = table(spark, d, "supplier").select(k.alias("run_id"), (k % 3 == 0).alias("gate_excluded"), F.when(k % 3 == 0, "first").alias("gate_excluded_reason"))
    retired = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(k.alias("run_id"), F.when(k % 4 == 0, F.concat(F.lit("old run of "), "s_name")).otherwise(" ").alias("reason"))
    return S.retire_runs(runs, "run_id", retired)


_wide = "event_id % 5 <> 0"
_body = f"""CASE event_id % 4 WHEN 0 THEN CASE WHEN {_wide} THEN concat('{{"hitPolicy":"FIRST","inputs":[{{"expression":"x","label":"a","typeRef":"n"}}],"outputs":[{{"label":"o","typeRef":"n"}}],"rules":[{{"annotation":null,"inputEntries":["', event_id % 3, '"],"outputEntries":["y"]}}]}}') END
    WHEN 1 THEN CASE WHEN {_wide} THEN concat('{{"initial":null,"states":["a","b"],"transitions":[{{"from":"a","guard":null,"to":"b","trigger":"t', event_id % 3, '"}}]}}') END
    WHEN 2 THEN concat('{{"expression":"a*b","meter":"m","scale":"', event_id % 3, '","variables":[]}}') ELSE CASE WHEN {_wide} THEN '{{"expression":"a > 0","notation":"sql","scope":"row"}}' END END"""


@query(f"SELECT event_id, body IS NOT NULL AS valid, body AS canonical FROM (SELECT event_id, {_body} AS body FROM events)")
def m13_structured_body(spark, d):
    """All four shapes with their keys in another order and a key too many; a fifth of them with a row too wide, a field missing
    or a word that is not allowed."""
    e = F.col("event_id")
    bad = lambda good, other: F.when(e % 5 != 0, F.lit(good)).otherwise(F.lit(other))
    raw = (
        F.when(e % 4 == 0, F.format_string('{"rules": [{"outputEntries": ["y"], "inputEntries": ["%d"%s]}], "more": 1, "hitPolicy": "FIRST", "inputs": [{"label": "a", "typeRef": "n", "expression": "x"}], "outputs": [{"typeRef": "n", "label": "o"}]}', e % 3, bad("", ', "z"')))
        .when(e % 4 == 1, F.format_string('{"transitions": [{"to": "b", "from": "a"%s}], "states": ["a", "b"]}', F.when(e % 5 != 0, F.format_string(', "trigger": "t%d"', e % 3)).otherwise("")))
        .when(e % 4 == 2, F.format_string('{"scale": "%d", "meter": "m", "expression": "a*b"}', e % 3)).otherwise(F.format_string('{"scope": "row", "notation": "%s", "expression": "a > 0"}', bad("sql", "latin")))
    )
    kind = F.get(F.array(*map(F.lit, S.BODIES)), (e % 4).cast("int"))
    return S.structured_bodies(table(spark, d, "events").select("event_id", kind.alias("kind"), raw.alias("raw")), "event_id", "kind", "raw")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END::BIGINT AS n_rules, CASE n_nationkey % 4 WHEN 3 THEN NULL WHEN 1 THEN 'c1' ELSE 'r' END AS first_name FROM nation")
def m16_either_key(spark, d):
    i = F.col("n_nationkey") % 4
    payload = F.when(i == 0, '{"rules": [{"name": "r"}]}').when(i == 1, '{"confirmedRules": [{"name": "c1"}, {"name": "c2"}]}').when(i == 2, '{"confirmedRules": [], "rules": [{"name": "r"}]}').otherwise("{}")
    rows = table(spark, d, "nation").select("n_nationkey", S.rule_list(payload, "struct<name:string>").alias("rules"))
    return rows.select("n_nationkey", F.when(F.col("rules").isNotNull(), F.size("rules").cast("long")).alias("n_rules"), F.get("rules", F.lit(0))["name"].alias("first_name"))


@query("SELECT doc_id, sha256(concat('body ', text)) AS content_hash FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0 AND text IS NOT NULL")
def m18_hash_backfill(spark, d):
    """A third of the documents stored without a hash; a seventh of the files changed since."""
    docs = table(spark, d, "documents")
    now = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    disk = docs.select("doc_id", F.sha2(now, 256).alias("sha"), F.sha2(F.concat(F.lit("body "), now), 256).alias("content_hash"))
    stored = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.when(F.col("doc_id") % 3 != 0, "known").alias("content_hash"))
    return S.hash_backfill(stored, disk, ["doc_id"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'callable' WHEN 'view' THEN 'type' ELSE 'other' END AS entity_class FROM events")
def m19_kind_shim(spark, d):
    return S.shimmed(table(spark, d, "events"), "event_type", {"click": "callable", "view": "type"}).select("event_id", "entity_class")


@query("SELECT vec_id, concat('domain=', coalesce(source, 'unassigned'), ';label=', label) AS meta FROM embeddings LEFT JOIN documents ON vec_id = doc_id")
def sk9_merge_metadata(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("domain"), F.lit("old")).alias("meta"))
    new = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("value"))
    rows = S.merged_metadata(rows, "vec_id", "meta", "domain", new, "unassigned")
    return rows.select("vec_id", F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st1_windowed_counts(spark, d):
    from ..streaming.incremental import event_counts

    return event_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT page_id, length(regexp_extract(lower(url), '(\\.[a-z]+)/', 1)) > 0 AS kept FROM pages WHERE NOT regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^(.*/)?de/.*(/.*)?$')")
def sc1_discovery(spark, d):
    from ..functions.text import glob_regex

    path = F.regexp_replace("url", "^[a-z]+://", "")
    rows = table(spark, d, "pages").filter(~path.rlike(glob_regex("**/de/**")))
    return rows.select("page_id", (F.length(F.regexp_extract(F.lower("url"), r"(\.[a-z]+)/", 1)) > 0).alias("kept"))
