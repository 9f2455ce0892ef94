"""Every registered query gives what its SQL gives, at the smallest scale; entry() returns rows."""

import duckdb

import __spark_entry__ as E
from recvfund.sources.tables import TABLES
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["classe_id", "data", "qtd_ativos", "valor_presente", "pdd", "a_receber"]


def test_every_query_gives_what_its_sql_gives(spark):
    from recvfund.plans.queries import QUERIES

    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and set(QUERIES) <= set(qs)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, fn in QUERIES.items():  # the optional subpackage has tests of its own
        df = fn(spark, SF)
        assert len(set(df.columns)) == len(df.columns), name
        want = con.sql(sql[name])
        assert sorted(df.columns) == sorted(want.columns), name
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall()), name
