"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

from check_oracles import compare, connect
from docloom.plans.oracles import ORACLES
from docloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, FOLDER).count() > 0
        return
    _, problem = compare(spark, con, FOLDER, QUERIES[name], ORACLES[name])
    assert problem is None, problem
