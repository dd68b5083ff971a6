"""Rows of the requirement store: statements, structured bodies, single fields and runs, gates and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of reasons, keywords of made statements, dispositions that need no pattern, shapes of bodies.
NEVER_MEASURED, UNACCOUNTED = "coverage not measured — completeness unknown", "%d chunks unaccounted for"
FALLBACK_KEYWORD = {"behavioral": "must", "definitional": "always"}
PATTERNLESS = ("not_applicable", "unreachable", "delegated")
BODIES = {
    "decision_table": "hitPolicy string, inputs array<struct<label:string,expression:string,typeRef:string>>, outputs array<struct<label:string,typeRef:string>>, rules array<struct<inputEntries:array<string>,outputEntries:array<string>,annotation:string>>",
    "state_transition": "states array<string>, initial string, transitions array<struct<`from`:string,to:string,trigger:string,guard:string>>",
    "formula": "scale string, meter string, expression string, variables array<struct<name:string,meaning:string,unit:string>>",
    "invariant": "expression string, scope string, notation string",
}
HIT_POLICIES, NOTATIONS = ("UNIQUE", "FIRST", "PRIORITY", "ANY", "COLLECT"), ("prose", "ocl", "sql")
LEAD = {"not null": "is empty", "enum": "has a value that is not allowed"}


def said(value: Column) -> Column:
    """A text without blanks around it; null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def statement(given: Column, name: Column, plain: Column, then: Column, rule_class: Column) -> Column:
    """The given statement, or one made of the rule's name and outcome with the keyword of its class."""
    table = F.create_map(*(F.lit(x) for kv in FALLBACK_KEYWORD.items() for x in kv))
    made = F.concat_ws(" ", F.coalesce(said(name), said(plain), F.lit("This rule")), F.coalesce(table[rule_class], F.lit("must")), F.coalesce(said(then), said(plain), F.lit("be reviewed")))
    return F.coalesce(F.when(said(given).isNotNull(), given), made)


def rule_list(payload: Column, schema: str) -> Column:
    """The rules of a payload (JSON), under rules or else under confirmedRules; null under neither."""
    parsed = F.from_json(payload, f"rules array<{schema}>, confirmedRules array<{schema}>")
    return F.coalesce(parsed["rules"], parsed["confirmedRules"])


def _sorted(value: Column, kind) -> Column:
    """value with the fields of all its structs in order of their names."""
    name = kind.typeName()
    if name == "array":
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if name == "struct":
        parts = F.struct(*(_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNotNull(), parts)
    return value


def structured_bodies(rows: DataFrame, key: str, kind: str, body: str) -> DataFrame:
    """key, valid, canonical of rows with a kind of body and the body as JSON: valid if the kind is known, all fields that the
    shape needs are there, and a table's rows are as wide as its columns; canonical is the body as JSON with sorted keys and
    nothing else, null if not valid."""
    from pyspark.sql.types import StructType

    shapes = {k: StructType.fromDDL(v) for k, v in BODIES.items()}
    every = lambda items, test: F.coalesce(F.forall(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    there = lambda *names: (lambda x: sum((x[n].isNull().cast("int") for n in names), F.lit(0)) == 0)
    parsed = {k: F.from_json(body, s) for k, s in shapes.items()}
    t, s, f, i = (F.col(f"_{k}") for k in BODIES)
    table = (
        t["hitPolicy"].isin(*HIT_POLICIES) & every(t["inputs"], there("label", "expression", "typeRef")) & every(t["outputs"], there("label", "typeRef"))
        & every(t["rules"], lambda r: (F.size(r["inputEntries"]) == F.size(t["inputs"])) & (F.size(r["outputEntries"]) == F.size(t["outputs"])))
    )
    tests = {
        "decision_table": table, "state_transition": s["states"].isNotNull() & every(s["transitions"], there("from", "to", "trigger")),
        "formula": there("scale", "meter", "expression")(f) & (f["variables"].isNull() | every(f["variables"], there("name", "meaning"))), "invariant": there("expression", "scope")(i) & i["notation"].isin(*NOTATIONS),
    }
    rows = rows.select(key, F.col(kind).alias("_kind"), *(p.alias(f"_{k}") for k, p in parsed.items()))
    valid, canonical = F.lit(False), F.lit(None).cast("string")
    for k, shape in shapes.items():
        of = F.col("_kind") == k
        whole = F.col(f"_{k}")
        if k == "formula":
            whole = F.when(whole.isNotNull(), whole.withField("variables", F.coalesce(whole["variables"], F.array().cast(shape["variables"].dataType))))
        valid = F.when(of, F.coalesce(tests[k], F.lit(False))).otherwise(valid)
        canonical = F.when(of & F.coalesce(tests[k], F.lit(False)), F.to_json(_sorted(whole, shape), {"ignoreNullFields": "false"})).otherwise(canonical)
    return rows.select(key, valid.alias("valid"), canonical.alias("canonical"))


def violations(rows: DataFrame, key: str, needed: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """key, column_name, reason of what a store of requirements refuses: empty columns that are needed, values that are not
    allowed, a definitional rule with an enforcement level, a pattern of the other class, an approved rule without a pattern.
    rows have rule_class, pattern, state, disposition and enforcement_level."""
    c = F.col
    prefix = F.when(c("rule_class") == "behavioral", "B-").otherwise("D-")
    tests = [
        *((n, LEAD["not null"], c(n).isNull()) for n in needed), *((n, LEAD["enum"], ~c(n).isin(*values)) for n, values in allowed.items()),
        ("enforcement_level", "a definitional rule cannot have one", (c("rule_class") == "definitional") & c("enforcement_level").isNotNull()),
        ("pattern", "is of the other class", c("rule_class").isNotNull() & ~c("pattern").startswith(prefix)),
        ("pattern", "an approved rule needs one", (c("state") == "approved") & c("pattern").isNull() & ~F.coalesce(c("disposition").isin(*PATTERNLESS), F.lit(False))),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(n).alias("column_name"), F.lit(why).alias("reason"))) for n, why, test in tests)))
    return rows.select(key, F.explode(found).alias("v")).select(key, "v.column_name", "v.reason")


def set_field(rows: DataFrame, key: str, column: str, edits: DataFrame) -> DataFrame:
    """rows with column set for the keys in edits (key, value), null included; others stay."""
    new = edits.select(key, F.col("value").alias("_value"), F.lit(True).alias("_edited"))
    return rows.join(new, key, "left").withColumn(column, F.when(F.col("_edited"), F.col("_value")).otherwise(F.col(column))).drop("_value", "_edited")


def retire_runs(runs: DataFrame, key: str, retired: DataFrame) -> DataFrame:
    """runs with gate_excluded and its reason for those in retired (key, reason); a blank reason retires nothing."""
    why = retired.filter(said(F.col("reason")).isNotNull()).select(key, F.col("reason").alias("_why"))
    rows = runs.join(why, key, "left")
    return rows.withColumns({"gate_excluded": F.col("gate_excluded") | F.col("_why").isNotNull(), "gate_excluded_reason": F.coalesce("_why", "gate_excluded_reason")}).drop("_why")


def blocking_runs(rows: DataFrame, hits: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, reason of the runs that keep rows (gr_id) from an export: those that hit one (hits: run_id, gr_id), are not
    excluded from the gate, and whose coverage was not measured or leaves chunks out (not_accounted_for)."""
    gave = hits.join(rows.select("gr_id"), "gr_id", "left_semi").select("run_id").distinct()
    left = runs.join(gave, "run_id", "left_semi").filter(~F.col("gate_excluded") & (F.coalesce("not_accounted_for", F.lit(1)) != 0))
    return left.select("run_id", F.when(F.col("not_accounted_for").isNull(), NEVER_MEASURED).otherwise(F.format_string(UNACCOUNTED, F.col("not_accounted_for").cast("long"))).alias("reason"))


def hash_backfill(stored: DataFrame, disk: DataFrame, keys: list[str]) -> DataFrame:
    """keys and content_hash of stored rows without one whose file (keys, sha) is on disk as it was stored."""
    return stored.filter("content_hash IS NULL").select(*keys, "sha").join(disk.select(*keys, "sha", F.col("content_hash")), [*keys, "sha"]).select(*keys, "content_hash")


def shimmed(rows: DataFrame, kind: str, classes: dict[str, str], name: str = "entity_class") -> DataFrame:
    """rows with the class of an old kind; other for kinds that are not in the closed list."""
    table = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))
    return rows.withColumn(name, F.coalesce(table[F.col(kind)], F.lit("other")))


def merged_metadata(rows: DataFrame, key: str, metadata: str, name: str, values: DataFrame, default: str) -> DataFrame:
    """rows with one entry of a map column set from values (key, value); the default where there is none; other entries stay."""
    new = values.select(key, F.col("value").alias("_value"))
    kept = F.map_filter(metadata, lambda k, v: k != name)
    return rows.join(new, key, "left").withColumn(metadata, F.map_concat(kept, F.create_map(F.lit(name), F.coalesce("_value", F.lit(default))))).drop("_value")


def run_audit(hits: DataFrame) -> DataFrame:
    """run_id, outcome, hits, first_offer: how often each outcome came of a run, and its first offer."""
    return hits.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("hits"), F.min("ordinal").alias("first_offer"))
