"""Operators that SQL can express, against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loreloom.llm import queries

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    expected = db.execute(queries.oracle_sql()[name])
    names = [x[0] for x in expected.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, expected.fetchall()))
