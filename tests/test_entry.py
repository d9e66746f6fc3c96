"""Driver contract and a DuckDB oracle sweep at sf0.001."""

import datetime as dt
import os

import pytest

import __spark_entry__ as E

def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert "narrative_summary" in q and len(o) >= 50


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"shared_narrative", "share_count", "influencers_involved",
                               "platforms_involved"}
    assert df.count() > 0


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle(spark, sf001, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(sf001):
        if t.endswith(".parquet"):
            con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{sf001}/{t}')")
    df = E.queries()[name](spark, sf001)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, df.collect()) == _rows(ocols, res.fetchall())
