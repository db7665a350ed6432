"""Every registered query against its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from relictum.queries import flagship, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    got = table(df.columns, df.collect())
    if name in oracle_sql():
        found = con.execute(oracle_sql()[name])
        assert got == table([d[0] for d in found.description], found.fetchall())


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark, sf_dir):
    assert flagship(spark, sf_dir).count() > 0
