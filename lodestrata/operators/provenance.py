"""Where files come from: third-party files by what they declare, their names and globs, and the tiers of a source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex, language, last_glob, suffix

# Formats that declare an origin and how, how much of a file is read for it, and tiers by suffix and name.
IDENTITY_SUFFIXES = (".tld", ".xsd", ".dtd")
IDENTITIES = (r"(?i)<uri>\s*([^<\s]+)\s*</uri>", r'(?i)targetNamespace\s*=\s*"([^"]+)"', r'(?i)PUBLIC\s+"([^"]+)"')
HEAD = 8000
TIERS = ("indexed", "credential", "referenced_content", "asset", "first_party_excluded", "gap")
CREDENTIALS, CREDENTIAL_NAMES = (".p12", ".jks", ".keystore", ".pfx", ".pem"), ("sstruststore", "cacerts")
REFERENCED = (".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".pdf", ".zip")
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".psd", ".ico", ".bmp", ".svg", ".woff", ".woff2", ".ttf", ".eot")


def _first(options: list[Column]) -> Column:
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def declared(path: Column, text: Column) -> Column:
    """The origin that a file of a declaring format states in its head; null if none."""
    head = F.substring(text, 1, HEAD)
    return F.when(suffix(path).isin(*IDENTITY_SUFFIXES), _first([F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in IDENTITIES]))


def third_party(files: DataFrame, own: list[str], names: list[str], globs: list[str]) -> DataFrame:
    """files (path, text) with rule and detail of the first rule that calls them third-party, and rescued.

    A declared origin decides alone, unless own (tokens of one's own origin) is empty: without one of these the file is foreign,
    with one it is not, whatever its path, and rescued if a glob claims it. Then names (patterns of paths), then globs."""
    path = F.col("path")
    stated = declared(path, F.col("text")) if own else F.lit(None).cast("string")
    ours = F.lit(False)
    for token in own:
        ours = ours | F.lower(F.col("stated")).contains(token.lower())
    rows = files.withColumn("stated", stated)
    by_name = _first([F.when(path.rlike(p), p) for p in names])
    by_glob = last_glob(path, globs)
    foreign, silent = F.col("stated").isNotNull() & ~ours, F.col("stated").isNull()
    rule = F.when(foreign, "declared_identity").when(silent & by_name.isNotNull(), "vendor_filename").when(silent & by_glob.isNotNull(), "vendored_globs")
    detail = F.when(foreign, F.col("stated")).when(silent, F.coalesce(by_name, by_glob))
    rescued = ~silent & F.coalesce(ours, F.lit(False)) & by_glob.isNotNull()
    return rows.withColumns({"rule": rule, "detail": detail, "rescued": rescued}).drop("stated")


def tiered(files: DataFrame, include: list[str], exclude: list[str], ours: list[str], most_bytes: int) -> DataFrame:
    """files (path, size_bytes) that no exclude glob takes, each with its one tier, why it is a gap (rejected_by) and the glob
    that excluded it (matched_glob). Keys and certificates are credentials whatever else holds."""
    path, end = F.col("path"), suffix(F.col("path"))
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    by_glob = last_glob(path, ours)
    inside = F.lit(False)
    for g in include:
        inside = inside | path.rlike(glob_regex(g))
    rows = files
    for g in exclude:
        rows = rows.filter(~path.rlike(glob_regex(g)))
    credential = F.coalesce(end.isin(*CREDENTIALS), F.lit(False)) | name.isin(*CREDENTIAL_NAMES) | F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").isin(*CREDENTIAL_NAMES)
    rows = rows.withColumns({"_credential": credential, "_in": inside, "_glob": by_glob, "_lang": language(path)})
    gap = F.when(~F.col("_in"), "include_globs").when(F.col("_lang").isNull(), "language").when(F.col("size_bytes") > most_bytes, "size_cap")
    tier = (
        F.when(F.col("_credential"), "credential").when(~F.col("_in") & end.isin(*REFERENCED), "referenced_content").when(~F.col("_in") & end.isin(*ASSETS), "asset")
        .when(F.col("_glob").isNotNull(), "first_party_excluded").when(gap.isNotNull(), "gap").otherwise("indexed")
    )
    rows = rows.withColumns({"tier": tier, "rejected_by": F.when(tier == "gap", gap), "matched_glob": F.when(tier == "first_party_excluded", F.col("_glob"))})
    return rows.drop("_credential", "_in", "_glob", "_lang")


def tier_totals(rows: DataFrame) -> DataFrame:
    """tier, files, size_bytes, line_count of tiered rows (size_bytes, line_count); tiers without files too."""
    every = rows.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    found = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"), F.sum("line_count").alias("line_count"))
    return F.broadcast(every).join(found, "tier", "left").fillna(0, ["files", "size_bytes", "line_count"])  # six rows
