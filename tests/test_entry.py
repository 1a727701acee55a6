"""Driver contract: registry shape and one oracle-checked query end to end."""

import duckdb

import __spark_entry__ as E
from transitrisk.sources.testdata import TABLES


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40
    assert all(callable(f) for f in q.values())


def test_one_query_against_its_oracle(spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = E.queries()["consecutive_edges"](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    cur = con.execute(E.oracle_sql()["consecutive_edges"])
    names = [d[0] for d in cur.description]
    exp = sorted(tuple(row[names.index(c)] for c in cols) for row in cur.fetchall())
    assert got == exp
