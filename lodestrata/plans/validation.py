"""Validator queries on statements made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validate as V
from .catalog import query, table

SENTENCES = (
    "If the order is late, the clerk must notify the customer and escalate the case.", "The system shall be able to send_mail to all vendors.", "An account is to be computed as the balance divided by totalAmt.", "A clerk may close an order only if the manager agrees or the limit is met.",
    "It must follow the policy if possible.", "The price always is significant.", "The base_fee is to be fixed at minRate by jdbc; vendors may pay. Only then will it be shown.",
)


def _rows(spark, d):
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    cores = spark.sparkContext.defaultParallelism  # few bytes, much work a row: every core takes part
    return table(spark, d, "orders").repartition(cores).select(k.alias("gr_id"), pick(SENTENCES, len(SENTENCES)).alias("statement"), F.when(k % 3 == 0, "behavioral").when(k % 3 == 1, "definitional").alias("rule_class"), F.when(k % 5 != 0, pick(sorted(V.PATTERNS), len(V.PATTERNS))).alias("pattern"),
        F.when(k % 2 == 0, "Calculation").otherwise("Validation").alias("category"), F.when(k % 4 == 0, "strict").when(k % 4 == 1, "wrong").alias("enforcement_level"), F.array(F.lit("vendors")).alias("terms"))


@query()
def v1_statement_checks(spark, d):
    return V.validate(_rows(spark, d), "gr_id")


_quoted = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in SENTENCES) + "]"
_r = f"""r AS (SELECT o_orderkey AS gr_id, {_quoted}[o_orderkey % {len(SENTENCES)} + 1] AS t, CASE o_orderkey % 3 WHEN 0 THEN 'behavioral' WHEN 1 THEN 'definitional' END AS c,
    CASE WHEN o_orderkey % 5 <> 0 THEN ['B-COND', 'B-PROHIB', 'B-RESTRICT', 'B-UNCOND', 'D-COMPUTE', 'D-CONST', 'D-IMPOSS', 'D-INFER', 'D-NEC', 'D-RESTRICT'][o_orderkey % 10 + 1] END AS p,
    CASE o_orderkey % 2 WHEN 0 THEN 'Calculation' ELSE 'Validation' END AS g, CASE o_orderkey % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'wrong' END AS e FROM orders)"""


def _places(pattern: str) -> str:
    """gr_id, a, b, w of a pattern's matches in r.t: what lies between them gives their places."""
    p = pattern.replace("'", "''")
    gaps, hits = f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x))", f"regexp_extract_all(t, '{p}')"
    return f"""(SELECT gr_id, list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, a + length(hits[i]) AS b, hits[i] AS w
        FROM (SELECT gr_id, {gaps} AS gaps, {hits} AS hits, unnest(range(1, len({hits}) + 1)) AS i FROM r))"""


_keys = r"(?i)\b(is\s+to\s+be\s+computed\s+as|is\s+to\s+be\s+considered|is\s+to\s+be\s+fixed\s+at|should\s+not|must\s+not|shall\s+not|not\s+always|need\s+not|must|should|shall|will|always|never|sometimes|may|can|only)\b"
_marks = rf"""k AS (SELECT gr_id, a, b, lower(regexp_replace(w, '\s+', ' ', 'g')) AS w FROM {_places(_keys)}), stop AS (SELECT gr_id, a FROM {_places(r'[.;!?](\s|$)')}),
    pair AS (SELECT k.*, (SELECT min(o.a) FROM k o WHERE o.gr_id = k.gr_id AND o.w = 'only' AND k.w IN ('may', 'can') AND o.a > k.a AND o.a < coalesce((SELECT min(s.a) FROM stop s WHERE s.gr_id = k.gr_id AND s.a >= k.a), 1000000)) AS o FROM k WHERE w <> 'only'),
    mark AS (SELECT gr_id, a, coalesce(o + 4, b) AS z, CASE WHEN o IS NULL THEN w ELSE concat(w, ' ... only') END AS keyword,
        CASE WHEN w IN ('may', 'must', 'should', 'must not', 'should not', 'need not') THEN 'behavioral' WHEN w NOT IN ('shall', 'shall not', 'will') THEN 'definitional' END AS keyword_class,
        CASE WHEN o IS NOT NULL THEN 'restricted' WHEN w IN ('shall', 'shall not', 'will') THEN 'forbidden' WHEN w IN ('may', 'need not', 'sometimes') THEN 'advice' ELSE 'rule' END AS kind,
        CASE WHEN o IS NULL THEN concat(a, '-', b) ELSE concat(a, '-', b, ',', o, '-', o + 4) END AS span FROM pair WHERE w <> 'can' OR o IS NOT NULL)"""
_tests = {
    "V-CLASS-01": "c IS NULL", "V-CLASS-02": "(g = 'Calculation' AND c = 'behavioral') OR (g = 'Validation' AND c = 'definitional')", "V-ENF-01": "e IS NOT NULL AND c = 'definitional'", "V-ENF-02": "e = 'wrong'", "V-ENF-03": "e IS NULL AND c = 'behavioral'",
    **{n: f"regexp_matches(t, '(?i){p}')" for n, p in {
        "V-KW-03": r"\b(shall\s+not|shall|will)\b", "V-VAG-01": r"\b(best|most)\b", "V-VAG-02": r"\b(user\s+friendly|easy\s+to\s+use|cost\s+effective)\b", "V-VAG-05": r"\b(provide\s+support|but\s+not\s+limited\s+to|as\s+a\s+minimum)\b|\betc\.",
        "V-VAG-06": r"\b(better\s+than|higher\s+quality)\b", "V-VAG-07": r"\b(if\s+possible|as\s+appropriate|as\s+applicable)\b", "V-STY-02": r"\b(shall|must)\s+be\s+able\s+to\b",
    }.items()},
}


@query()
def v1_statement_checks(spark, d):
    return V.validate(_rows(spark, d), "gr_id")


@query(f"WITH {_r} " + " UNION ALL ".join(f"SELECT gr_id, '{n}' AS finding_id FROM r WHERE {test}" for n, test in _tests.items()))
def v1_native_checks(spark, d):
    return V.native_findings(_rows(spark, d), "gr_id")


@query()
def v5_blocked_rows(spark, d):
    return V.blocking(V.validate(_rows(spark, d), "gr_id"), "gr_id")


@query(f"WITH {_r}, {_marks} SELECT gr_id, keyword, keyword_class, kind, span FROM mark")
def v2_keywords(spark, d):
    return V.keywords(_rows(spark, d), "gr_id")


@query()
def v3_slots(spark, d):
    return V.slots(_rows(spark, d), "gr_id")


_shapes = (
    r"\bvendors\b", r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\b", r"\b\w*_\w+\b", r"\b[a-z][a-z0-9]*[A-Z]\w*\b", r"\b[A-Z][a-z0-9]+[A-Z]\w*\b", r"\b\w+Exception\b", r"\b[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){2,}\b",
    r"(?i)\b(servlet|jsp|jdbc|hibernate|struts|ejb|dao|dto|pojo|resultset|stored procedure|http request|http response|null pointer|database table|foreign key)\b",
)


@query(f"""WITH {_r}, {_marks}, found AS ({" UNION ".join(f"SELECT gr_id, a, b, w FROM {_places(p)}" for p in _shapes)}),
    free AS (SELECT gr_id, any_value(z) AS z FROM mark JOIN r USING (gr_id) WHERE kind IN ('rule', 'restricted') GROUP BY gr_id
        HAVING count(*) = 1 AND (any_value(p) = 'D-CONST' AND any_value(keyword) = 'is to be fixed at' OR any_value(p) = 'D-INFER' AND any_value(keyword) = 'is to be considered'))
    SELECT gr_id, concat(a, '-', b) AS span, w AS words FROM found LEFT JOIN free USING (gr_id) WHERE free.z IS NULL OR found.a < free.z""")
def v4_leaks(spark, d):
    return V.leaks(_rows(spark, d), "gr_id")


@query()
def v5_refreshed(spark, d):
    """Findings after a third of the rows lost their pattern and a seventh of them went."""
    rows = _rows(spark, d)
    changed = rows.filter("gr_id % 3 = 0").withColumn("pattern", F.lit(None).cast("string"))
    return V.refreshed(V.checked(rows, "gr_id"), changed, rows.filter("gr_id % 7 = 0"), "gr_id")
