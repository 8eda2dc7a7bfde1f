"""Every registered query against its DuckDB statement on sf0.001."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

from seasonlens.plans.catalog import QUERIES as CORE  # noqa: E402

SF = "/root/testdata/sf0.001"
# The library's own queries; those of the llm subpackage are tested in tests/llm.
QUERIES = {n: q for n, q in entry.queries().items() if n in CORE}
ORACLE = {n: q for n, q in entry.oracle_sql().items() if n in CORE}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(CORE) == set(ORACLE)


def test_entry_works_without_the_training_data_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "seasonlens.llm", None)
    assert set(entry.queries()) == set(CORE) and set(entry.oracle_sql()) == set(CORE)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["puuid", "year", "summary_json"]
    assert df.count() > 0
