import pytest

from checks.compare import differences, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    assert differences(spark, con, sf_dir, name) == []


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_point(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "emplid" and "FINANC_3000_SEM_ELI" in df.columns
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
