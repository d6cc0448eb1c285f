"""Registered queries on the smallest tables, against their check queries where there are any."""

import oracle
import pytest

from tallyworks.llm import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_check_query(spark, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), ORACLES[name]) == ""


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
