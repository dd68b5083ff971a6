"""The requirement store: offers merged in two stages, field policies, lifecycle and import guards, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import meeting

#: Lifecycle (fixed values): allowed transitions, and ranks for the import guard.
TRANSITIONS = (
    ("draft", "reviewed"), ("draft", "approved"), ("draft", "rejected"), ("reviewed", "approved"), ("reviewed", "rejected"), ("reviewed", "draft"), ("approved", "superseded"), ("approved", "rejected"), ("rejected", "draft"),
)
RANKS = {"draft": 0, "rejected": 0, "reviewed": 1, "approved": 2, "superseded": 3}


def outcomes(offers: DataFrame, stored: DataFrame) -> DataFrame:
    """Stage one. offers (ordinal, dk, dka) with outcome: merged (the key is stored or came before), candidate (another row,
    stored or inserted before, has the anchor key) or new; gr_ref is the row that an offer is in: the stored one of its key,
    else the first offer's (its ordinal as text).

    Offers and stored rows are aggregated together, once by each key; groups are combined in each task, so that a common key is
    no single task's work."""
    known = stored.select("dk", "dka", F.lit(None).cast("long").alias("ordinal"), F.col("gr_id").alias("stored_id"))
    by_key = offers.select("dk", "ordinal", F.lit(None).cast("string").alias("stored_id")).unionByName(known.drop("dka")).groupBy("dk").agg(F.min("stored_id").alias("stored_id"), F.min("ordinal").alias("first"))
    rows = offers.join(by_key, "dk").withColumn("inserts", F.col("stored_id").isNull() & (F.col("first") == F.col("ordinal")))
    # An anchor's stored row, or else its earliest insertion, decides for all later ones.
    seen = rows.filter("inserts").select("dka", "ordinal").unionByName(known.select("dka", F.lit(-1).cast("long").alias("ordinal")))
    rows = rows.join(seen.groupBy("dka").agg(F.min("ordinal").alias("earliest")), "dka", "left")
    drift = F.coalesce(F.col("earliest") < F.col("ordinal"), F.lit(False))
    outcome = F.when(~F.col("inserts"), "merged").when(drift, "candidate").otherwise("new")
    return rows.select("ordinal", "dka", outcome.alias("outcome"), F.coalesce("stored_id", F.col("first").cast("string")).alias("gr_ref"))


def drift_pairs(found: DataFrame, stored: DataFrame) -> DataFrame:
    """ordinal, other: each drift candidate of stage one (found) with every stored row of its anchor key and every row inserted
    before it."""
    new = found.filter("outcome = 'candidate'").select("ordinal", "dka")
    inserted = found.filter("outcome != 'merged'").select("dka", F.col("ordinal").alias("at"), F.col("gr_ref").alias("other"))
    others = stored.select("dka", F.lit(-1).cast("long").alias("at"), F.col("gr_id").alias("other")).unionByName(inserted)
    return new.join(others, "dka").filter(F.col("at") < F.col("ordinal")).select("ordinal", "other").distinct()


def overlap_pairs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs (id, other) whose citations (path, start_line, end_line) overlap on one file, each once, not with itself."""
    return meeting(incoming, stored, "path").select(F.col("r.id").alias("id"), F.col("s.id").alias("other")).filter("id != other").distinct()


def second_stage(found: DataFrame, cites: DataFrame, stored_cites: DataFrame, near: DataFrame) -> DataFrame:
    """ordinal, other, reason, similarity of the pairs that offers which stage one (found) calls new raise: semantic (near:
    ordinal, other, similarity, against what was stored before the run) and overlap.

    Overlap is of an inserting offer's citations (cites: ordinal, path, start_line, end_line) with those of other rows: the
    stored ones (stored_cites: gr_id and lines) and those of earlier offers, each for the row that its offer is in."""
    second = found.filter("outcome = 'new'").select("ordinal", F.col("gr_ref").alias("own"))
    semantic = near.join(second, "ordinal").filter(F.col("other") != F.col("own")).select("ordinal", "other", F.lit("semantic").alias("reason"), "similarity")
    lines = ["path", "start_line", "end_line"]
    cited = cites.join(found.select("ordinal", "outcome", F.col("gr_ref").alias("own")), "ordinal")
    others = stored_cites.select(F.col("gr_id").alias("other"), F.lit(-1).cast("long").alias("at"), *lines).unionByName(cited.select(F.col("own").alias("other"), F.col("ordinal").alias("at"), *lines))
    hit = meeting(cited.filter("outcome = 'new'").select("ordinal", "own", *lines), others, "path").filter((F.col("s.at") < F.col("r.ordinal")) & (F.col("r.own") != F.col("s.other")))
    overlap = hit.select("r.ordinal", "s.other").distinct().select("ordinal", "other", F.lit("overlap").alias("reason"), F.lit(None).cast("double").alias("similarity"))
    return semantic.unionByName(overlap)


def merge_pairs(found: DataFrame, stored: DataFrame, cites: DataFrame, stored_cites: DataFrame, near: DataFrame) -> DataFrame:
    """Both stages: ordinal, other, reason, similarity of all pairs that an ingest raises: drift (the anchor key, then nothing
    else is looked for), else what the second stage finds. found is stage one, which the caller writes once."""
    drift = drift_pairs(found, stored).select("ordinal", "other", F.lit("drift").alias("reason"), F.lit(None).cast("double").alias("similarity"))
    return drift.unionByName(second_stage(found, cites, stored_cites, near))


def merge_outcomes(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """ordinal, outcome, gr_ref after both stages: an offer that stage one calls new is a candidate if it has any pair."""
    raised = pairs.select("ordinal").distinct().withColumn("raised", F.lit(True))
    rows = found.join(raised, "ordinal", "left")
    return rows.select("ordinal", F.when((F.col("outcome") == "new") & F.col("raised"), "candidate").otherwise(F.col("outcome")).alias("outcome"), "gr_ref")


def merged_fields(existing: DataFrame, incoming: DataFrame, key: str, owned: list[str], shadowed: list[str], human: list[str]) -> DataFrame:
    """existing rows after a merge: owned fields take what comes; shadowed ones only if unedited (live equals shadow,
    nulls too), their shadow always; human ones stay. changed says whether any value moved."""
    both = existing.alias("e").join(incoming.alias("i"), key, "left").withColumn("hit", F.col(f"i.{owned[0]}").isNotNull() | F.col(f"i.{key}").isNotNull())
    e, i = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"i.{c}"))
    new: dict[str, Column] = {c: F.when(F.col("hit"), i(c)).otherwise(e(c)) for c in owned}
    for c in shadowed:
        new[c] = F.when(F.col("hit") & e(c).eqNullSafe(e(f"{c}_extracted")), i(c)).otherwise(e(c))
        new[f"{c}_extracted"] = F.when(F.col("hit"), i(c)).otherwise(e(f"{c}_extracted"))
    new |= {c: e(c) for c in human}
    moved = F.lit(False)
    for c, v in new.items():
        moved = moved | ~v.eqNullSafe(e(c))
    return both.select(key, *(v.alias(c) for c, v in new.items()), moved.alias("changed"))


def candidate_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pairs (existing, incoming): new ones are unresolved; known ones take the similarity only while unresolved."""
    keys = ["existing_id", "incoming_id"]
    both = stored.withColumnRenamed("similarity", "old").join(incoming.withColumnRenamed("similarity", "new"), keys, "full_outer")
    open_ = F.coalesce("resolution", F.lit("unresolved"))
    return both.select(*keys, F.when((open_ == "unresolved") & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("similarity"), open_.alias("resolution"))


def transitions(changes: DataFrame, blocking: DataFrame) -> DataFrame:
    """changes (id, old, new, pattern) with verdict: illegal transition, blocked (approval without a pattern or with a
    blocking finding), else ok."""
    legal = F.lit(False)
    for a, b in TRANSITIONS:
        legal = legal | ((F.col("old") == a) & (F.col("new") == b))
    bad = blocking.select("id").distinct().withColumn("has_error", F.lit(True))
    rows = changes.join(bad, "id", "left")
    return rows.select("id", F.when(~legal, "illegal").when((F.col("new") == "approved") & (F.col("pattern").isNull() | F.col("has_error").isNotNull()), "blocked").otherwise("ok").alias("verdict"))


def rank_of(state: Column) -> Column:
    """The rank of a state; one that is not known ranks lowest."""
    out = F.lit(0)
    for s, r in RANKS.items():
        out = F.when(state == s, r).otherwise(out)
    return out


def import_guard(stored: DataFrame, incoming: DataFrame, key: str, review: list[str], other: list[str]) -> DataFrame:
    """Imported rows; where the incoming state has a lower rank than the stored one, state and review columns stay."""
    both = incoming.alias("i").join(stored.alias("s"), key, "left")
    lower = F.coalesce(rank_of(F.col("i.state")) < rank_of(F.col("s.state")), F.lit(False))
    keep = [F.when(lower, F.col(f"s.{c}")).otherwise(F.col(f"i.{c}")).alias(c) for c in ["state", *review]]
    return both.select(key, *keep, *(F.col(f"i.{c}") for c in other), lower.alias("guarded"))


def export_jsonl(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """key, line: each parent as one JSON object with sorted keys and its children in order; the same on every run."""
    kids = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("k"))
    shape = F.transform(F.coalesce("k", F.array().cast(kids.schema["k"].dataType)), lambda c: F.struct(*(c[f].alias(f) for f in sorted(fields))))
    parts = {c: F.col(c) for c in parents.columns} | {name: shape}
    return parents.join(kids, key, "left").select(key, F.to_json(F.struct(*(parts[c].alias(c) for c in sorted(parts))), {"ignoreNullFields": "false"}).alias("line")).orderBy(key)


def run_coverage(runs: DataFrame, key: str, payload: str) -> DataFrame:
    """key, not_accounted_for, complete of extractor payloads (JSON): the whole number under coverage.uncovered, null where it
    is none or coverage was skipped; complete only if it is measured and 0."""
    said = F.try_parse_json(payload)
    number = F.schema_of_variant(F.try_variant_get(said, "$.coverage.uncovered", "variant")) == "BIGINT"  # a text of digits is no number
    skipped = F.coalesce(F.try_variant_get(said, "$.coverage.skipped", "boolean"), F.lit(False))
    n = F.when(~skipped & number, F.try_variant_get(said, "$.coverage.uncovered", "long"))
    return runs.select(key, n.alias("not_accounted_for"), F.coalesce(n == 0, F.lit(False)).alias("complete"))
