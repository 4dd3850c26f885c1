"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import connection, difference

from tremorframe.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert not difference(got, duck.execute(ORACLES[name]).df())
    else:
        assert len(got.columns) and len(got)
