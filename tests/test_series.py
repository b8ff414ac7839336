import math
import statistics
from decimal import Decimal

import pytest

from tidebook.operators import liquidity, series
from tidebook.plans import queries as plans

DAY = 86400


@pytest.fixture(scope="module")
def price(spark):
    rows = [(1, 0, 5), (2, 10, None), (3, 20, 9), (4, 30, -4), (5, DAY, 7), (6, DAY + 5, 0)]
    return spark.createDataFrame(
        [(s, s, "A", "B", t, last) for s, t, last in rows],
        "seq long, height long, token0 string, token1 string, time_unix long, last int",
    )


@pytest.fixture(scope="module")
def block(price):
    return price.select("height", "time_unix")


def test_ohlc(price):
    rows = {r["time_unix"]: tuple(r)[3:] for r in series.ohlc(price, "day").collect()}
    assert rows == {0: (5, 9, -4, -4), DAY: (7, 7, 0, 0)}


def test_first_last_in_bucket(price):
    rows = series.first_last_in_bucket(price, "day").collect()
    assert len(rows) == 5
    assert {(r["bucket"], r["first_price"], r["last_price"]) for r in rows} == {(0, 5, -4), (DAY, 7, 0)}


def test_orientation_twice_is_the_identity(price):
    plain = series.ohlc(price, "day")
    turned = liquidity.orient_pair(plain, True, "price")
    row = turned.where("time_unix = 0").first()
    assert (row["open"], row["high"], row["low"], row["close"]) == (-5, 4, -9, 4)
    assert row["low"] <= row["open"] <= row["high"]
    again = liquidity.orient_pair(turned, True, "price")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        liquidity.orient_pair(plain, True, "else")


def test_pair_in_either_order(price, block):
    straight = plans.price_series(price, block, "day", 0, 6, token_a="A", token_b="B").orderBy("time_unix").collect()
    turned = plans.price_series(price, block, "day", 0, 6, token_a="B", token_b="A").orderBy("time_unix").collect()
    assert [r["close"] for r in straight] == [-4, 0]
    assert [r["close"] for r in turned] == [4, 0]
    assert plans.price_series(price, block, "day", 0, 6, token_a="A", token_b="Z").count() == 0


def test_range_keeps_whole_buckets(price, block):
    # from the middle of the first day: its bucket is complete, from its start
    row = plans.price_series(price, block, "day", 3, 6).orderBy("time_unix").first()
    assert (row["time_unix"], row["open"]) == (0, 5)


def test_large_swaps_do_not_leave_the_range(spark):
    swaps = spark.createDataFrame(
        [(i, "A", "B", "A", 0, Decimal(9 * 10**36), 100) for i in range(3)] + [(9, "A", "B", "B", 0, Decimal(6 * 10**37), 100)] * 2,
        "seq long, token0 string, token1 string, token_in string, time_unix long, reserves_diff decimal(38,0), fee int",
    )
    row = series.swap_volume_timeseries(swaps, "day").first()
    assert row["amount0"] == pytest.approx(2.7e37) and row["amount1"] == pytest.approx(1.2e38)
    assert row["fee0"] == pytest.approx(2.7e35) and row["fee1"] == pytest.approx(1.2e36)


def test_swap_volume(spark):
    rows = [
        ("A", 10, 5), ("A", -4, 5), ("B", 100, 20), ("B", 7, None),
    ]
    swaps = spark.createDataFrame(
        [(i, "A", "B", tin, 0, Decimal(d), fee) for i, (tin, d, fee) in enumerate(rows)],
        "seq long, token0 string, token1 string, token_in string, time_unix long, reserves_diff decimal(38,0), fee int",
    )
    row = series.swap_volume_timeseries(swaps, "day").first()
    assert (row["amount0"], row["amount1"]) == (10.0, 107.0)
    assert (row["fee0"], row["fee1"]) == (0.005, 0.2)
    unknown_fee = series.swap_volume_timeseries(swaps.where("token_in = 'B' and fee is null"), "day").first()
    assert (unknown_fee["amount1"], unknown_fee["fee1"]) == (7.0, None)
    assert series.swap_volume_timeseries(swaps.where("reserves_diff < 0"), "day").count() == 0


def _closes(spark, ticks):
    return spark.createDataFrame(
        [("A", "B", day * DAY, tick) for day, tick in ticks], "token0 string, token1 string, time_unix long, close int"
    )


def test_daily_closes_fill_quiet_days(spark):
    daily = _closes(spark, [(3, 50), (6, 70)])
    found = {r["day"]: r["close"] for r in series.daily_close_asof(daily, 8 * DAY + 5, 8).collect()}
    assert found == {1: 70, 2: 70, 3: 50, 4: 50, 5: 50}


def test_volatility(spark):
    ticks = [(day, (day * 37) % 11 * 10) for day in range(1, 23)]
    closes = series.daily_close_asof(_closes(spark, ticks), 23 * DAY)
    returns = series.daily_returns(closes)
    prices = [1.0001 ** dict(ticks)[22 - i] for i in range(21)]
    changes = [prices[i] / prices[i + 1] - 1 for i in range(20)]
    rows = {r["time_unix"]: r["volatility"] for r in series.volatility(returns, 23 * DAY).collect()}
    assert rows == {
        13 * DAY: pytest.approx(math.sqrt(252) * statistics.stdev(changes[:10])),
        3 * DAY: pytest.approx(math.sqrt(252) * statistics.stdev(changes[10:])),
    }
    few = returns.where("position <= 12")
    assert series.volatility(few, 23 * DAY).count() == 1
    assert series.volatility(few, 23 * DAY, strict=False).count() == 2


def test_volatility_does_not_depend_on_the_order(spark):
    price = spark.createDataFrame(
        [(d, d, "A", "B", d * DAY + 7, (d * 31) % 13) for d in range(1, 24)],
        "seq long, height long, token0 string, token1 string, time_unix long, last int",
    )
    block = price.select("height", "time_unix")
    now = 23 * DAY + 60
    one = plans.stats_volatility(price, block, now, 23, token_a="A", token_b="B").collect()
    two = plans.stats_volatility(price, block, now, 23, token_a="B", token_b="A").collect()
    assert len(one) == 2
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_stddev(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    rows = {r["k"]: r["stddev"] for r in series.sample_stddev(df, ["k"], "v").collect()}
    assert rows == {"a": pytest.approx(math.sqrt(2)), "b": None}
    assert series.sample_stddev(df, ["k"], "v", True).where("k = 'a'").first()["stddev"] == 1.0


def test_stats_windows(spark):
    # now is 10:01:00 of day 3, so the buckets start at 10:01:00 of the days before
    now = 3 * DAY + 36060
    times = [DAY + 36059, DAY + 36060, 2 * DAY, 2 * DAY + 36060, 3 * DAY]
    price = spark.createDataFrame(
        [(i, i, "A", "B", t, i) for i, t in enumerate(times, 1)],
        "seq long, height long, token0 string, token1 string, time_unix long, last int",
    )
    block = price.select("height", "time_unix")
    rows = plans.stats_price_24h(price, block, now, 5).collect()
    found = {r["time_unix"]: (r["open"], r["close"]) for r in rows}
    # heights after (now - 48h) are 3 on; the first bucket is floored without the offset, to the start of day 2
    assert found == {DAY + 36060: (3, 3), 2 * DAY + 36060: (4, 5)}
