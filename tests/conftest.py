import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from retentia.session import build_local  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_local(memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def many_ranges(spark):
    """Keep every shuffle partition, so that tiny frames still span several ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, "true")


@pytest.fixture(scope="session")
def small(spark):
    from retentia.plans.etl import warehouse

    return warehouse(spark, SMALL)
