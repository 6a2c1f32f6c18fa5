import __spark_entry__ as entry


def test_catalogue_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120


def test_flagship(spark):
    df = entry.entry(spark)
    assert "z" in df.columns and df.count() >= 0
