"""The driver's contract: every query of the engine's own against its DuckDB twin at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from millrace import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return float(v) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def test_names():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and set(core.QUERIES) <= set(names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_twin(spark, name):
    got = core.QUERIES[name](spark, SF)
    if name not in core.SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(core.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert a == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)
