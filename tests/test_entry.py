import duckdb

import __spark_entry__ as entry


def test_queries_and_sql_agree_in_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 80 and set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in sql.values())


def test_flagship(spark, sf):
    rows = entry.entry(spark).count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert rows == len(con.execute(entry.oracle_sql()["occ_per_window"]).fetchall()) > 0
