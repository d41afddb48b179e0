"""Every query of the library against the SQL that must give its rows; those without SQL must give a stable schema."""

import compare
import pytest

from driftline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert compare.difference(spark, duck, "sf0.001", catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, str(compare.DATA / "sf0.001"))
    assert df.schema == catalog.queries()[name](spark, str(compare.DATA / "sf0.001")).schema
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert entry.oracle_sql().keys() <= entry.queries().keys()
