import importlib

import pytest

from checks.compare import differences, duck
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    problem, _ = differences(spark, con, name, SMALL)
    assert not problem


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLE) == {"q_search_layouts"}
