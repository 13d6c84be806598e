"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyfield.operators import pool

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, views, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    found = views.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    plain = lambda v: v + 0 if isinstance(v, float) else v
    want = sorted(repr([plain(r[columns.index(c)]) for c in df.columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in df.columns]) for r in got) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_sample_moves_reviews_once(spark, monkeypatch):
    """One exchange where games fit a task; games that don't, here most or all, go by slices, with the same rows."""
    for name in ("quota_sample", "sample_report"):
        df = entry.queries()[name](spark, FOLDER)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, name
        for rows in (600, 0):
            monkeypatch.setattr(pool, "GAME_ROWS", rows)
            other = entry.queries()[name](spark, FOLDER)
            assert other.dtypes == df.dtypes and sorted(map(repr, other.collect())) == sorted(map(repr, df.collect())), (name, rows)
        monkeypatch.undo()
