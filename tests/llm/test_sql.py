"""Queries of this package against their reference SQL."""

import pytest

from checks import compare as C
from retentia.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return C.open_duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name, monkeypatch):
    monkeypatch.setattr(C, "QUERIES", QUERIES)
    monkeypatch.setattr(C, "ORACLES", ORACLES)
    assert C.compare(spark, duck, SMALL, name) is None
