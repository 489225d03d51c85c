"""Every registered query against its SQL, and the rest for their rows."""

import pytest

from quire.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck, data, same_rows):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    if name in catalogue.ORACLES:
        same_rows(got, duck.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
