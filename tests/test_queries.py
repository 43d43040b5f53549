"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None
