"""Every query with SQL gives the rows that DuckDB gives on the smallest tables; all queries run and keep their schema."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v) + 0.0:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in registry.ORACLES:
        found = duck.sql(registry.ORACLES[name])
        assert sorted(found.columns) == names
        at = [found.columns.index(c) for c in names]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["lodestrata.llm", "public_tokenizers"])
def test_entry_without_llm_or_what_it_needs(monkeypatch, missing):
    import builtins
    import sys

    real = builtins.__import__
    for name in [n for n in sys.modules if n.startswith("lodestrata.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(missing) or (missing == "lodestrata.llm" and name == "corpus_pipeline"):
            raise ModuleNotFoundError(name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    assert set(entry.queries()) == set(registry.QUERIES)
