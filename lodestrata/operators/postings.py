"""A stored positional index: postings of terms with their places, and raw queries that are matched and ranked from them alone.

Postings are written in order of (term, key) over range partitions: a term's rows lie together, a term that is very common lies
in several files, and a search reads the row groups of its terms and prefixes only. Texts are not read again. New texts are added as
further files; a search unites what lies in the folder.

A query is made of units: a word, a prefix*, a "phrase" (whose last word may be a prefix) and NEAR(words, n), each in one
column if col: stands before it. Units are joined by AND, OR, NOT, parentheses, or nothing, as in keyword_search, and each unit is
ranked by the number of its occurrences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import RawQuery, _score, ranked

#: Tokens that a NEAR without a number may have in between.
NEAR = 10


@dataclass
class Unit:
    """Words that stand one after the other, or near each other (apart: tokens in between at most); last: the last is a prefix."""

    words: list[str]
    last: bool = False
    apart: int | None = None
    column: str | None = None


class IndexedQuery(RawQuery):
    """A raw query over units: matches(f) tests an array of the units' counts, terms are the units to rank by."""

    def __init__(self, raw: str):
        self.units: list[Unit] = []
        super().__init__(raw)

    def _one(self):
        part, column = self._next(), None
        if part and (named := re.fullmatch(r"(\w+):(.*)", part)):
            column, rest = named.groups()
            self.parts[self.at : self.at + 1] = [rest] if rest else []
            part = self._next()
        if part == "NEAR" and self.parts[self.at + 1 : self.at + 2] == ["("]:
            end = self.parts.index(")", self.at)
            said = " ".join(self.parts[self.at + 2 : end])
            self.at = end + 1
            apart = re.search(r",\s*(\d+)\s*$", said)
            words = re.findall("[a-z0-9]+", (said[: apart.start()] if apart else said).lower())
            if len(words) < 2:
                raise ValueError("NEAR needs two words or more")
            return self._unit(Unit(words, apart=int(apart[1]) if apart else NEAR, column=column))
        if part in (None, "(", ")", "OR", "AND", "NOT"):
            if column:
                raise ValueError(f"a term is missing after {column}:")
            return super()._one()
        self.at += 1
        words = re.findall("[a-z0-9]+", part.lower())
        if not words:
            raise ValueError(f"{part} has no word")
        return self._unit(Unit(words, last=part.rstrip('"').endswith("*"), column=column))

    def _unit(self, unit: Unit):
        self.units.append(unit)
        i = len(self.units) - 1
        self.terms.append(i)
        return lambda f: F.get(f, F.lit(i)) > 0


def write_index(docs: DataFrame, folder: str, key: str = "doc_id", columns: tuple[str, ...] = ("text",), mode: str = "errorifexists") -> None:
    """Adds the columns' terms to the index in folder; mode append for further rows, whose keys must be new."""
    parts = [docs.select(F.col(key).alias("key"), F.lit(c).alias("col"), tokens(F.col(c)).alias("w")) for c in columns]
    words = reduce(DataFrame.unionByName, parts)
    placed = words.select("key", "col", F.posexplode("w").alias("at", "term")).groupBy("term", "key", "col").agg(F.sort_array(F.collect_list("at")).alias("places"))
    placed.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode(mode).parquet(f"{folder}/postings")
    words.groupBy("key").agg(F.sum(F.size("w")).alias("len")).write.mode(mode).parquet(f"{folder}/lengths")


def _places(term: str, prefix: bool, column: str | None) -> Column:
    """All places of a term in a document's postings (hits), columns kept apart."""
    test = lambda e: (e["term"].startswith(term) if prefix else e["term"] == term) & (F.lit(True) if column is None else e["col"] == column)
    return F.flatten(F.transform(F.filter("hits", test), lambda e: F.transform(e["places"], lambda p: F.struct(e["col"].alias("col"), p.alias("at")))))


def _count(unit: Unit) -> Column:
    """How often a unit occurs in a document."""
    last = len(unit.words) - 1
    where = [_places(w, unit.last and i == last, unit.column) for i, w in enumerate(unit.words)]
    if unit.apart is not None:
        within = lambda p: lambda q: (q["col"] == p["col"]) & (q["at"] >= p["at"]) & (q["at"] <= p["at"] + unit.apart + 1)
        return F.size(F.filter(F.array_distinct(F.concat(*where)), lambda p: reduce(lambda a, b: a & b, (F.exists(w, within(p)) for w in where))))
    moved = lambda p, i: F.struct(p["col"].alias("col"), (p["at"] + i).alias("at"))
    return F.size(F.filter(where[0], lambda p: reduce(lambda a, b: a & b, (F.array_contains(w, moved(p, i)) for i, w in enumerate(where[1:], 1)), F.lit(True))))


def search_index(spark: SparkSession, folder: str, raw: str, k: int) -> DataFrame:
    """key, score, rank of the k best matches of a raw query (BM25 over its units), from the index alone."""
    query = IndexedQuery(raw)
    postings, lengths = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths")
    exact = sorted({w for u in query.units for w in (u.words[:-1] if u.last else u.words)})
    wanted = reduce(lambda a, b: a | b, (F.col("term").startswith(u.words[-1]) for u in query.units if u.last), F.col("term").isin(exact))
    hits = postings.filter(wanted).groupBy("key").agg(F.collect_list(F.struct("term", "col", "places")).alias("hits"))  # the query's terms in one document
    counted = hits.select("key", *(_count(u).alias(f"c{i}") for i, u in enumerate(query.units)))
    rows = counted.select("key", F.array(*(f"c{i}" for i in range(len(query.units)))).alias("f"))
    scored = rows.select("key", "f", *(F.get("f", F.lit(u)).alias(f"f{i}") for i, u in enumerate(query.terms)))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl")).crossJoin(scored.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(query.terms)))))  # two single rows
    found = scored.filter(query.matches(F.col("f"))).join(lengths, "key").crossJoin(F.broadcast(stats))  # one row
    return ranked(found.select("key", F.round(_score(len(query.terms)), 6).alias("score")), [F.desc("score"), F.col("key")], k)
