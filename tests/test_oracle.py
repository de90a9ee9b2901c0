"""Every registered query against its reference SQL, on the smallest tables."""

import pytest

from checks.compare import compare, open_duck
from checks.queries import ORACLES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return open_duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, SMALL, name) in (None, "equal, but empty")


def test_entry_runs(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert df.count() == 3
    assert set(driver.oracle_sql()) <= set(driver.queries())
