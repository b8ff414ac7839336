import pytest

from tests import brute
from tidebook.operators import state
from tidebook.operators.dimensions import join_event_time
from tidebook.plans import endpoints
from tidebook.plans.endpoints import Asked


@pytest.fixture(scope="module")
def tables(spark):
    log = [
        (1, 1, "A", "B", "A", 3, 1, 50),
        (2, 2, "A", "B", "B", 4, 1, 12345),
        (3, 3, "A", "B", "A", 2, 1, 7),
        (4, 4, "A", "B", "A", 2, 1, 0),
        (5, 5, "B", "C", "B", 1, 1, 9),
    ]
    updates = brute.frame(spark, log)
    block = spark.createDataFrame([(h, h * 60) for h in range(1, 7)], "height long, time_unix long")
    return {
        "block": block,
        "versions": state.tick_state_versions(updates),
        "price": join_event_time(state.best_price_series(updates), block),
        "reserves": join_event_time(state.reserves_series(updates), block),
        "swaps": join_event_time(state.reserves_diff(updates), block),
    }


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_series(tables):
    block, asked = tables["block"], Asked(last_completed=5)
    price = rows(endpoints.timeseries_price(tables["price"], block, "A", "B", asked))
    assert [(t, close) for t, _, _, _, close in price] == [(240, -3), (180, -2), (120, 4), (60, -3)]
    turned = rows(endpoints.timeseries_price(tables["price"], block, "B", "A", asked))
    assert [(t, close) for t, _, _, _, close in turned] == [(240, 3), (180, 2), (120, -4), (60, 3)]
    page = rows(endpoints.timeseries_price(tables["price"], block, "A", "B", Asked(5, offset=1, limit=2)))
    assert [r[0] for r in page] == [180, 120]
    timed = rows(endpoints.timeseries_price(tables["price"], block, "A", "B", Asked(5, after=60, before=180)))
    assert [r[0] for r in timed] == [180, 120]
    tvl = rows(endpoints.timeseries_tvl(tables["reserves"], block, "B", "A", asked, "hour"))
    assert tvl == [(0, 12345.0, 50.0)]
    volume = rows(endpoints.timeseries_volume(tables["swaps"], block, "A", "B", asked, "hour"))
    assert volume == [(0, 57.0, 12345.0, 57 / 10000, 1.2345)]


def test_range_priorities(tables):
    block = tables["block"]
    assert Asked(5).heights(block) == (0, 5)
    assert Asked(4, after=60, before=10**6).heights(block) == (1, 4)
    assert Asked(5, after=60, from_height=3, to_height=9).heights(block) == (3, 5)
    assert Asked(5, after=30, before=45).heights(block) == (0, 0)


def test_liquidity(tables):
    versions = tables["versions"]
    assert rows(endpoints.liquidity_pair(versions, "A", "B", Asked(5))) == [(0, -3, 50.0), (1, -4, 12300.0)]
    assert rows(endpoints.liquidity_pair(versions, "B", "A", Asked(5))) == [(0, -4, 12300.0), (1, -3, 50.0)]
    assert rows(endpoints.liquidity_token(versions, "B", "A", Asked(5))) == [(-4, 12300.0)]
    # a removed tick shows up as zero in a delta only
    assert rows(endpoints.liquidity_pair(versions, "A", "B", Asked(5, from_height=2))) == [(0, -2, 0.0)]


def test_ranking(spark, tables):
    prices = spark.createDataFrame([("C", 1.0), ("B", 100.0)], "token string, unit_price double")
    ranked = endpoints.liquidity_pairs(tables["reserves"], prices, Asked(5)).select("rank", "token0", "reserves1")
    assert rows(ranked) == [(1, "A", 12350.0), (2, "B", 0.0)]
    delta = endpoints.liquidity_pairs(tables["reserves"], prices, Asked(5, from_height=4))
    assert [r["token0"] for r in delta.collect()] == ["B"]


def test_stats(tables):
    block = tables["block"]
    price = endpoints.stats_price(tables["price"], block, "A", "B", 360, 6)
    assert [(r["time_unix"], r["close"]) for r in price.collect()] == [(360 - 86400, -3)]
    assert endpoints.stats_tvl(tables["reserves"], block, "A", "B", 360, 6).count() == 1
    assert endpoints.stats_volume(tables["swaps"], block, "A", "B", 360, 6).count() == 1
    assert endpoints.stats_volatility(tables["price"], block, "A", "B", 360, 6).count() == 0
