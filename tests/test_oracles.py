"""Register and split-path checks; every query against DuckDB: ``test_registry.py``."""

import pytest

from swapledger.plans import all_oracles, all_queries
from tests.compare import diff, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())


def test_hot_keys_change_nothing(spark, con):
    """Force the split path on every table and compare again."""
    from swapledger.sources.tables import Tables

    before = Tables.hot_rows
    Tables.hot_rows = 3
    try:
        for name in ("src_02_leg_counter", "win_22_carried_state", "agg_42_appearances"):
            assert diff(all_queries()[name](spark, SF), con, all_oracles()[name]) == ""
    finally:
        Tables.hot_rows = before
