"""Every registered query of the library equals its SQL, or gives rows where it has none."""

import pytest
from compare import assert_same, connection

from lacuna.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).count() == 1
