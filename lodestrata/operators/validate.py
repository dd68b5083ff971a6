"""Statement checks: 28 checks of a requirement's wording, each finding with its place in the statement.

Everything is a column expression over one row, in three steps that later ones read as columns: the places of modal
keywords (marks), the slots that a template per pattern cuts around the one rule keyword, and a table of checks, each a list
of places. Places are code points, end exclusive; -1 stands for the whole row. No Python runs on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import places
from ..tables import written

# Keywords with class and kind, keywords of each pattern, levels and word lists.
KEYWORDS = {
    "must": ("behavioral", "rule"), "should": ("behavioral", "rule"), "must not": ("behavioral", "rule"), "should not": ("behavioral", "rule"),
    "always": ("definitional", "rule"), "never": ("definitional", "rule"), "not always": ("definitional", "rule"),
    "is to be computed as": ("definitional", "rule"), "is to be considered": ("definitional", "rule"), "is to be fixed at": ("definitional", "rule"),
    "need not": ("behavioral", "advice"), "sometimes": ("definitional", "advice"), "shall": (None, "forbidden"), "shall not": (None, "forbidden"), "will": (None, "forbidden"),
}
PATTERNS = {
    "B-COND": ("must", "should"), "B-UNCOND": ("must", "should"), "B-PROHIB": ("must not", "should not"), "B-RESTRICT": ("may ... only",),
    "D-NEC": ("always",), "D-IMPOSS": ("never", "not always"), "D-RESTRICT": ("can ... only",), "D-COMPUTE": ("is to be computed as",), "D-INFER": ("is to be considered",), "D-CONST": ("is to be fixed at",),
}
NEED_CONDITION = ("B-COND", "B-PROHIB", "B-RESTRICT", "D-RESTRICT", "D-INFER")
LEVELS = ("strict", "deferred", "pre-authorized", "post-justified", "override", "guideline")
BANNED = ("the system", "the application", "the software", "the program")
PRONOUNS = ("it", "this", "that")
VAGUE = {
    "V-VAG-01": ("best", "most"), "V-VAG-02": ("user friendly", "easy to use", "cost effective"), "V-VAG-05": ("provide support", "but not limited to", "as a minimum", "etc."),
    "V-VAG-06": ("better than", "higher quality"), "V-VAG-07": ("if possible", "as appropriate", "as applicable"), "V-VAG-08": ("all", "always", "never", "every"),
}
AMBIGUOUS, LOGICAL = ("almost always", "significant", "minimal"), ("or", "and/or")
REFERENCES = ("ISO", "IEEE", "RFC", "ANSI", "NIST", "CFR", "the standard", "the specification", "the policy", "the manual", "the regulation", "the agreement")
DESIGNATORS = ("part", "rev", "revision", "version", "edition", "annex", "clause", "section")
DETERMINERS = ("the", "a", "an", "its", "their", "his", "her", "this", "that", "these", "those", "each", "every", "all", "any", "no", "both", "either", "one", "two", "three")
FUNCTION_WORDS = (
    *DETERMINERS, "of", "to", "in", "on", "for", "with", "by", "from", "at", "as", "into", "over", "under", "within", "across", "not", "then", "if", "when", "only", "or", "and", "is", "are", "was", "were", "be", "been", "being", "it", "they", "he", "she",
)
FRAMEWORK = ("servlet", "jsp", "jdbc", "hibernate", "struts", "ejb", "dao", "dto", "pojo", "resultset", "stored procedure", "http request", "http response", "null pointer", "database table", "foreign key")
CODE_SHAPES = (r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\b", r"\b\w*_\w+\b", r"\b[a-z][a-z0-9]*[A-Z]\w*\b", r"\b[A-Z][a-z0-9]+[A-Z]\w*\b", r"\b\w+Exception\b", r"\b[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){2,}\b")
PASSIVE = (r"\bit\s+is\s+required\s+that\b", r"\bit\s+shall\s+be\s+possible\s+to\b", r"\bis\s+to\s+be\s+(?!(?:computed\s+as|considered|fixed\s+at)\b)\w+(?:ed|en)\s+by\b")
ABLE = r"\b(?:shall|must)\s+be\s+able\s+to\b"

#: How a pattern cuts a statement: whether a clause before a comma may stand in front of the subject, where the body is (the
#: action after the keyword, the action between a keyword's two parts, or a value), and the word that opens a condition after it.
TEMPLATES = {
    "B-COND": (True, "action", None), "B-PROHIB": (True, "action", None), "B-UNCOND": (False, "action", None), "D-NEC": (False, "action", None), "D-IMPOSS": (False, "action", None),
    "B-RESTRICT": (False, "between", "only if"), "D-RESTRICT": (False, "between", "only if"), "D-COMPUTE": (False, "value", None), "D-CONST": (False, "value", None), "D-INFER": (False, "value", "if"),
}
COLUMNS = ("statement", "rule_class", "pattern", "category", "enforcement_level", "terms")
ANY_CASE, UNICODE = "(?iU)", "(?U)"
WORD = "[A-Za-z][A-Za-z0-9'-]*"

_place = "struct<start:int,end:int>"
_none = lambda kind=_place: F.array().cast(f"array<{kind}>")
_words = lambda values: F.array(*map(F.lit, values))


def terms_pattern(terms) -> str:
    """Whole terms in any case and spacing; of terms that begin alike the longest counts."""
    ends = lambda t: (r"(?<!\w)" if t[0].isalnum() else "", r"(?!\w)" if t[-1].isalnum() else "")
    spaced = lambda t: r"\s+".join(w.replace(".", r"\.") for w in t.split())
    return ANY_CASE + "|".join(ends(t)[0] + spaced(t) + ends(t)[1] for t in sorted(terms, key=lambda t: (-len(t), t)))


def _templated(test) -> Column:
    """Whether the row's pattern has a template of which test holds."""
    names = [p for p, t in TEMPLATES.items() if test(t)]
    return F.coalesce(F.col("pattern").isin(names), F.lit(False))


def _cut(text: Column, a: Column, b: Column) -> Column:
    """The place from a to b without blanks, commas and semicolons around it, nor full stops after it; null if nothing is left."""
    part = F.substring(text, a + 1, b - a)
    first = F.char_length(part) - F.char_length(F.regexp_replace(part, r"(?U)^[\s,;]+", ""))
    last = F.char_length(F.regexp_replace(part, r"(?U)[\s.,;]+\z", ""))
    return F.when((a < b) & (first < last), F.struct((a + first).alias("start"), (a + last).alias("end")))


def read(rows: DataFrame) -> DataFrame:
    """rows (COLUMNS) with text, marks, rules (marks that state a rule), sure (a template applies) and the slots subject,
    condition, action and value."""
    text = F.coalesce("statement", F.lit(""))
    word = lambda p: F.lower(F.regexp_replace(p["match"], r"(?U)\s+", " "))
    hits = F.transform(places(text, terms_pattern([*KEYWORDS, "may", "can", "only"])), lambda p: F.struct(word(p).alias("word"), p["start"].alias("start"), p["end"].alias("end")))
    stops = F.transform(places(text, r"(?U)[.;!?](?=\s|\z)"), lambda p: p["start"])
    rows = rows.select("*", text.alias("text"), F.char_length(text).alias("n"), hits.alias("hits"), stops.alias("stops"), (F.locate(",", text) - 1).alias("comma"), places(text, ANY_CASE + r"\s+if\b").alias("ifs"), places(text, ANY_CASE + r"\bonly\s+if\b").alias("only_ifs"))

    modal = lambda h: h["word"].isin("may", "can")
    until = lambda h: F.coalesce(F.array_min(F.filter("stops", lambda s: s >= h["start"])), F.col("n"))
    only = lambda h: F.get(F.filter("hits", lambda o: modal(h) & (o["word"] == "only") & (o["start"] > h["start"]) & (o["start"] < until(h))), F.lit(0))
    rows = rows.withColumn("paired", F.transform(F.filter("hits", lambda h: h["word"] != "only"), lambda h: F.struct(h.alias("hit"), only(h).alias("only"))))
    table = lambda i: F.create_map(*(F.lit(x).cast("string") for k, v in KEYWORDS.items() for x in (k, v[i])))

    def mark(p):
        h, o = p["hit"], p["only"]
        two = o.isNotNull()
        cls = F.when(h["word"] == "may", "behavioral").when(h["word"] == "can", "definitional").otherwise(table(0)[h["word"]])
        kind = F.when(two, "restricted").when(h["word"] == "may", "advice").otherwise(table(1)[h["word"]])
        return F.struct(
            F.when(two, F.concat(h["word"], F.lit(" ... only"))).otherwise(h["word"]).alias("word"), cls.alias("cls"), kind.alias("kind"), h["start"].alias("start"), F.coalesce(o["end"], h["end"]).alias("end"),
            h["end"].alias("gap_start"), o["start"].alias("gap_end"),
        )

    rows = rows.withColumn("marks", F.transform(F.filter("paired", lambda p: (p["hit"]["word"] != "can") | p["only"].isNotNull()), mark))
    rows = rows.withColumn("rules", F.filter("marks", lambda m: m["kind"].isin("rule", "restricted")))
    known = F.create_map(*(x for k, v in PATTERNS.items() for x in (F.lit(k), _words(v))))
    rows = rows.withColumn("rule", F.get("rules", F.lit(0)))
    rows = rows.withColumn("sure", F.coalesce((F.size("rules") == 1) & F.array_contains(known[F.col("pattern")], F.col("rule.word")), F.lit(False)))
    t, n, comma, rule, zero = F.col("text"), F.col("n"), F.col("comma"), F.col("rule"), F.lit(0)
    first = lambda column, test=lambda p: F.lit(True): F.get(F.filter(column, test), zero)
    ahead = _templated(lambda x: x[0]) & (comma >= 0) & (comma < rule["start"])
    opened = F.when(_templated(lambda x: x[2] == "only if"), first("only_ifs", lambda p: p["start"] == rule["gap_end"])).when(_templated(lambda x: x[2] == "if"), first("ifs", lambda p: p["start"] >= rule["end"]))
    loose = F.coalesce(first("only_ifs"), first("ifs"))
    rows = rows.withColumns({"ahead": ahead, "opened": F.when(F.col("sure"), opened).otherwise(loose)})
    clause, after = _cut(t, zero, comma), _cut(t, F.col("opened.end"), n)
    rows = rows.withColumns({
        "subject": F.when(F.col("sure"), _cut(t, F.when(F.col("ahead"), comma + 1).otherwise(0), rule["start"])),
        "condition": F.when(F.col("sure"), F.when(F.col("ahead"), clause).otherwise(after)).otherwise(F.when(comma >= 0, clause).otherwise(after)),
        "value": F.when(F.col("sure") & _templated(lambda x: x[1] == "value"), _cut(t, rule["end"], F.coalesce(F.col("opened.start"), n))),
    })
    between = rule["kind"] == "restricted"
    a, b = F.when(between, rule["gap_start"]).otherwise(rule["end"]), F.when(between, rule["gap_end"]).otherwise(n)
    bare = F.col("pattern").isNull() & rule.isNotNull()
    short = F.when(F.col("condition.start") >= a, F.least(b, F.col("condition.start"))).otherwise(b)
    return rows.withColumn("action", F.when(F.col("sure") & _templated(lambda x: x[1] != "value"), _cut(t, a, b)).when(~F.col("sure") & bare, _cut(t, a, short)))


def _inside(slot: str) -> Column:
    return F.substring(F.col("text"), F.col(f"{slot}.start") + 1, F.col(f"{slot}.end") - F.col(f"{slot}.start"))


def _bare(found: Column) -> Column:
    return F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))


def _all(pattern: str | Column) -> Column:
    return _bare(places(F.col("text"), pattern))


def _in_action(pattern: str) -> Column:
    """Places of a pattern within the action, as places of the statement, with what follows each there."""
    shift = F.col("action.start")
    moved = F.transform(places(_inside("action"), pattern), lambda p: F.struct((shift + p["start"]).alias("start"), (shift + p["end"]).alias("end")))
    return F.when(F.col("action").isNotNull(), moved).otherwise(_none())


def _second_actions() -> Column:
    """Places of an "and" in the action after which a word that is no function word stands alone or before a determiner."""

    def joins(p):
        rest = F.substring(F.col("text"), p["end"] + 1, F.col("action.end") - p["end"])
        words = F.transform(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)), F.lower)
        following = F.get(words, F.lit(1))
        return (F.size(words) > 0) & ~F.get(words, F.lit(0)).isin(*FUNCTION_WORDS) & (following.isNull() | following.isin(*DETERMINERS))

    return F.filter(_in_action(ANY_CASE + r"\band\b"), joins)


def _open_references() -> Column:
    """References without a number or designator in the 30 characters after them, up to a comma, semicolon or full stop."""

    def bare(p):
        near = F.get(F.split(F.substring(F.col("text"), p["end"] + 1, F.lit(30)), "[,;.]"), F.lit(0))
        named = F.exists(F.regexp_extract_all(near, F.lit(WORD), F.lit(0)), lambda w: F.lower(w).isin(*DESIGNATORS))
        return ~F.rlike(near, F.lit(r"\p{Nd}")) & ~named

    return F.filter(_all(terms_pattern(REFERENCES)), bare)


def leak_places() -> Column:
    """Places of technical terms: the row's own terms of three characters or more, shapes of code, and words of frameworks;
    none within a value that may be a literal."""
    quoted = lambda t: F.concat(F.lit(r"(?U)\b\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    own = F.flatten(F.transform(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.char_length(t) >= 3), lambda t: F.when(F.contains(F.col("text"), t), _all(quoted(t))).otherwise(_none())))
    found = F.array_sort(F.array_distinct(F.concat(own, *(_all(UNICODE + p) for p in CODE_SHAPES), _all(terms_pattern(FRAMEWORK)))))
    free = F.when(F.col("pattern").isin("D-CONST", "D-INFER"), F.col("value"))
    return F.filter(found, lambda p: ~F.coalesce((free["start"] <= p["start"]) & (p["end"] <= free["end"]), F.lit(False)))


def _row(test: Column) -> Column:
    """The whole row as a place where test holds."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))).otherwise(_none())


def _marks(column: str, test) -> Column:
    return _bare(F.filter(column, test))


def _slot(slot: str, among) -> Column:
    said = F.lower(F.trim(_inside(slot)))
    return F.when(F.col(slot).isNotNull() & said.isin(*among), F.array(F.col(slot))).otherwise(_none())


def _terms(name: str) -> Column:
    found = _all(terms_pattern(VAGUE[name]))
    if name != "V-VAG-08":
        return found
    own = lambda p: F.exists("rules", lambda m: (m["cls"] == "definitional") & (m["start"] < p["end"]) & (p["start"] < m["end"]))
    return F.filter(found, lambda p: ~(F.coalesce(F.col("rule_class") == "definitional", F.lit(False)) & own(p)))


def checks() -> list[tuple[str, str, Column, Column | None]]:
    """(id, severity, places, when the check cannot be decided: then the row is reported as not evaluated)."""
    c = F.col
    no_class, no_template = c("rule_class").isNull(), ~c("sure")
    prefix = F.when(c("rule_class") == "behavioral", "B-").otherwise("D-")
    weak = c("enforcement_level").isNull() | c("enforcement_level").isin("strict", "deferred")
    empty = lambda test, found: F.when(test, found).otherwise(_none())
    return [
        ("V-CLASS-01", "ERROR", _row(no_class), None),
        ("V-CLASS-02", "WARN", _row(((c("category") == "Calculation") & (c("rule_class") == "behavioral")) | ((c("category") == "Validation") & (c("rule_class") == "definitional"))), None),
        ("V-KW-01", "ERROR", _row(~F.exists("rules", lambda m: m["cls"] == c("rule_class"))), no_class),
        ("V-KW-02", "ERROR", F.concat(_marks("rules", lambda m: m["cls"] != c("rule_class")), _row(~c("pattern").startswith(prefix))), no_class),
        ("V-KW-03", "ERROR", _marks("marks", lambda m: m["kind"] == "forbidden"), None),
        ("V-KW-04", "ERROR", _bare(F.slice("rules", 2, F.greatest(F.size("rules"), F.lit(1)))), None),
        ("V-KW-05", "ERROR", empty(weak, _marks("rules", lambda m: m["word"].isin("should", "should not"))), None),
        ("V-KW-06", "ERROR", empty(F.size("rules") == 0, F.slice(_marks("marks", lambda m: m["kind"] == "advice"), 1, 1)), None),
        ("V-KW-07", "WARN", _marks("marks", lambda m: m["word"] == "may"), None),
        ("V-SLOT-01", "ERROR", _row(c("subject").isNull()), no_template),
        ("V-SLOT-02", "ERROR", _slot("subject", BANNED), no_template),
        ("V-SLOT-03", "ERROR", _row(c("pattern").isin(*NEED_CONDITION) & c("condition").isNull()), no_template),
        *((name, "ERROR", _terms(name), None) for name in VAGUE),
        ("V-VAG-03", "ERROR", _slot("subject", PRONOUNS), no_template | c("subject").isNull()),
        ("V-VAG-04", "ERROR", F.concat(_all(terms_pattern(AMBIGUOUS)), _in_action(terms_pattern(LOGICAL))), None),
        ("V-VAG-09", "ERROR", _open_references(), None),
        ("V-SING-01", "ERROR", _second_actions(), None),
        ("V-STY-01", "ERROR", F.concat(*(_all(ANY_CASE + p) for p in PASSIVE)), None),
        ("V-STY-02", "ERROR", _all(ANY_CASE + ABLE), None),
        ("V-STY-03", "WARN", leak_places(), None),
        ("V-ENF-01", "ERROR", _row(c("enforcement_level").isNotNull() & (c("rule_class") == "definitional")), None),
        ("V-ENF-02", "ERROR", _row(~c("enforcement_level").isin(*LEVELS)), None),
        ("V-ENF-03", "WARN", _row((c("rule_class") == "behavioral") & c("enforcement_level").isNull()), None),
    ]


def _span(place: Column) -> Column:
    return F.when(place["start"] < 0, "").otherwise(F.concat_ws("-", place["start"].cast("string"), place["end"].cast("string")))


#: Different rows whose findings may be sent to all tasks; more are joined by a shuffle, with the same result.
FEW = 10_000


def checked(rows: DataFrame, key: str) -> DataFrame:
    """key, found: the findings of each of rows (COLUMNS) as an array of (finding_id, severity, span, evaluated). What rows say is
    checked once however many say it; the findings of different rows are a table of their own, which goes when the driver ends."""
    def told(name: str, severity: str, where: Column, done: bool) -> Column:
        return F.transform(where, lambda p: F.struct(F.lit(name).alias("finding_id"), p["start"].alias("start"), p["end"].alias("end"), F.lit(severity).alias("severity"), F.lit(done).alias("evaluated")))

    each = []
    for name, severity, where, undecided in checks():
        decided = told(name, severity, where, True)
        each.append(decided if undecided is None else F.when(undecided, told(name, severity, _row(F.lit(True)), False)).otherwise(decided))
    found = read(rows.select(*COLUMNS).distinct()).select(*COLUMNS, F.array_distinct(F.concat(*each)).alias("f"))
    finding = lambda f: F.struct(f["finding_id"].alias("finding_id"), f["severity"].alias("severity"), _span(f).alias("span"), f["evaluated"].alias("evaluated"))
    found = written(found.select(*(F.col(c).alias(f"of_{c}") for c in COLUMNS), F.transform("f", finding).alias("found")))
    found = F.broadcast(found) if found.count() <= FEW else found.hint("merge")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in COLUMNS))
    return rows.select(key, *COLUMNS).join(found, same).select(key, "found")


def listed(found: DataFrame, key: str) -> DataFrame:
    """key, finding_id, severity, span, evaluated of checked rows."""
    return found.select(key, F.explode("found").alias("f")).select(key, "f.*")


def validate(rows: DataFrame, key: str) -> DataFrame:
    """key, finding_id, severity, span, evaluated of rows (COLUMNS); span is start-end, empty for the whole row."""
    return listed(checked(rows, key), key)


def keywords(rows: DataFrame, key: str) -> DataFrame:
    """key, keyword, keyword_class, kind, span of the modal keywords; a pair (may ... only) has two spans, comma-joined."""
    rows = read(rows.select(key, *COLUMNS)).select(key, F.explode_outer("marks").alias("m")).filter("m IS NOT NULL")  # outer: so that the optimizer does not test the array before it is made, which would expand all steps into one test
    dash = lambda a, b: F.concat_ws("-", F.col(a).cast("string"), F.col(b).cast("string"))
    span = F.when(F.col("m.gap_end").isNotNull(), F.concat_ws(",", dash("m.start", "m.gap_start"), dash("m.gap_end", "m.end"))).otherwise(dash("m.start", "m.end"))
    return rows.select(key, F.col("m.word").alias("keyword"), F.col("m.cls").alias("keyword_class"), "m.kind", span.alias("span"))


def slots(rows: DataFrame, key: str) -> DataFrame:
    """key, slot, span, words, unsure of the slots of each statement that are filled; unsure if no template applies."""
    rows = read(rows.select(key, *COLUMNS))
    filled = F.array(*(F.struct(F.lit(s).alias("slot"), F.col(s).alias("p")) for s in ("subject", "condition", "action", "value")))
    rows = rows.select(key, "text", "sure", F.explode_outer(F.filter(filled, lambda x: x["p"].isNotNull())).alias("s")).filter("s IS NOT NULL")
    return rows.select(key, "s.slot", _span(F.col("s.p")).alias("span"), F.substring(F.col("text"), F.col("s.p.start") + 1, F.col("s.p.end") - F.col("s.p.start")).alias("words"), (~F.col("sure")).alias("unsure"))


def leaks(rows: DataFrame, key: str) -> DataFrame:
    """key, span, words of the technical terms in each statement."""
    rows = read(rows.select(key, *COLUMNS)).select(key, "text", F.explode_outer(leak_places()).alias("p")).filter("p IS NOT NULL")
    return rows.select(key, _span(F.col("p")).alias("span"), F.substring(F.col("text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("words"))


def blocking(findings: DataFrame, key: str) -> DataFrame:
    """Rows that may not be approved: those with an evaluated ERROR."""
    return findings.filter("severity = 'ERROR' AND evaluated").select(key).distinct()


def refreshed(findings: DataFrame, changed: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Stored findings after some rows changed (they are checked anew) and some went (their findings go). The stored ones are
    a list, or as checked() gives them, row by row; the result is a list."""
    kept = findings.join(changed.select(key).unionByName(gone.select(key)), key, "left_anti")
    anew = checked(changed.join(gone.select(key), key, "left_anti"), key)
    if "found" in findings.columns:
        return listed(kept.unionByName(anew), key)
    return kept.unionByName(listed(anew, key))


def native_findings(rows: DataFrame, key: str) -> DataFrame:
    """key, finding_id of the checks that need no places: whether there is a finding at all, by tests on the row alone."""
    t = F.coalesce("statement", F.lit(""))
    c = {
        "V-CLASS-01": F.col("rule_class").isNull(),
        "V-CLASS-02": F.expr("(category = 'Calculation' AND rule_class = 'behavioral') OR (category = 'Validation' AND rule_class = 'definitional')"),
        "V-ENF-01": F.expr("enforcement_level IS NOT NULL AND rule_class = 'definitional'"),
        "V-ENF-02": F.col("enforcement_level").isNotNull() & ~F.col("enforcement_level").isin(*LEVELS),
        "V-ENF-03": F.expr("enforcement_level IS NULL AND rule_class = 'behavioral'"),
        "V-KW-03": t.rlike(terms_pattern([k for k, v in KEYWORDS.items() if v[1] == "forbidden"])),
        **{name: t.rlike(terms_pattern(words)) for name, words in VAGUE.items() if name != "V-VAG-08"},
        "V-STY-01": t.rlike(ANY_CASE + "|".join(PASSIVE)),
        "V-STY-02": t.rlike(ANY_CASE + ABLE),
    }
    found = F.array_compact(F.array(*(F.when(p, n) for n, p in c.items())))
    return rows.select(key, F.explode(found).alias("finding_id"))
