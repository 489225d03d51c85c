import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    assert len(entry.entry(spark).take(1)) == 1


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
