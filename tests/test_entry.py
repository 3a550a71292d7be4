import __spark_entry__ as entry_module


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
