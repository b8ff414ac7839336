"""Registered queries against their SQL on the smallest tables.

One query per group runs by default; ``CHECK_ALL=1`` runs every one, as ``python -m checks.compare`` does.
"""

import os

import pytest

from checks.compare import check, duck
from checks.oracle import ORACLES
from checks.queries import REGISTERED
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_of_the_package_has_sql():
    assert set(ORACLES) == set(REGISTERED)
    assert set(oracle_sql()) <= set(queries())


SOME = [
    "load_events",
    "event_tick_update",
    "first_seen_ids",
    "reserves_diff",
    "tick_state_versions",
    "best_price_series",
    "reserves_series",
    "ohlc",
    "tvl_timeseries",
    "swap_volume_timeseries",
    "tick_liquidity_delta",
    "pairs_liquidity_delta",
    "stats_volatility",
    "height_at_time",
    "ibc_asset_match",
    "pages",
    "suppress_repeats",
    "stream_volume_windows",
]


@pytest.mark.parametrize("name", sorted(REGISTERED) if os.environ.get("CHECK_ALL") else SOME)
def test_query(spark, con, name):
    ok, text, _ = check(spark, con, SF_DIR, name)
    assert ok, text


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["token0", "token1", "time_unix", "amount0", "amount1"]
    assert df.count() > 0
