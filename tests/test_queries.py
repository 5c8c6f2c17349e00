import pytest

from logweave.plans.catalog import CATALOG

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(CATALOG))
def test_against_sql(spark, name):
    query, sql = CATALOG[name]
    assert sql, "every query of the engine has SQL"
    assert compare(spark, query, sql, SF) is None


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
