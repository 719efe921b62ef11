"""Every registered query against its SQL on the smallest generated tables."""

from pathlib import Path

import oracle_check
import pytest

import __spark_entry__ as contract
from workload import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="generated tables are absent")


#: Queries without rows on the smallest tables.
EMPTY = {"rolling_ratio_sampled", "unreliable_weeks", "without_coordinates"}


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(str(FOLDER))


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    run, sql = QUERIES[name], ORACLES[name]
    assert oracle_check.compare(spark, con, str(FOLDER), run, sql) == ("both empty" if name in EMPTY else None)
