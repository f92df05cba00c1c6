import __spark_entry__ as entry


def test_registered_queries_have_names_and_sql_has_queries():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 70 and set(sql) <= set(queries)


def test_entry_has_rows(spark):
    rows = entry.entry(spark)
    assert rows.columns[0] == "pair" and rows.count() > 0
