import __spark_entry__ as entry


def test_every_oracle_has_its_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
