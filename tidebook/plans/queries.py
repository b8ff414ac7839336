"""The public queries over warehouse tables: series, liquidity and statistics.

Every query takes an optional pair. Without one it answers for all pairs in stored order; with ``token_a, token_b``
the result is turned to that order. ``now`` and heights are explicit arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import as_column, day_offset, floor_to_minute
from tidebook.operators import liquidity, ranges, series

HOUR = 3600
DAY = 86400


def _oriented(df: DataFrame, token_a: str | None, token_b: str | None, kind: str) -> DataFrame:
    if token_a is None or token_b is None:
        return df
    chosen = series.of_pair(df, token_a, token_b)
    return liquidity.orient_pair(chosen, F.col("token0") == F.lit(token_b), kind)


def _series(kind, compute, rows, block, resolution, from_height, to_height, offset, token_a, token_b, options):
    if token_a is not None and token_b is not None:
        rows = series.of_pair(rows, token_a, token_b)
    inside = series.ranged(rows, block, from_height, to_height, resolution, offset, **options)
    return _oriented(compute(inside, resolution, offset), token_a, token_b, kind)


def price_series(
    price: DataFrame,
    block: DataFrame,
    resolution: str = "minute",
    from_height: Column | int = 0,
    to_height: Column | int = 0,
    offset: Column | int = 0,
    token_a: str | None = None,
    token_b: str | None = None,
    **options,
) -> DataFrame:
    """Open, high, low and close per bucket."""
    return _series(
        "price", series.ohlc, price, block, resolution, from_height, to_height, offset, token_a, token_b, options
    )


def tvl_series(
    reserves: DataFrame,
    block: DataFrame,
    resolution: str = "minute",
    from_height: Column | int = 0,
    to_height: Column | int = 0,
    offset: Column | int = 0,
    token_a: str | None = None,
    token_b: str | None = None,
    **options,
) -> DataFrame:
    """Last reserves per bucket."""
    return _series(
        "amounts", series.tvl_timeseries, reserves, block, resolution, from_height, to_height, offset,
        token_a, token_b, options,
    )


def volume_series(
    swaps: DataFrame,
    block: DataFrame,
    resolution: str = "minute",
    from_height: Column | int = 0,
    to_height: Column | int = 0,
    offset: Column | int = 0,
    token_a: str | None = None,
    token_b: str | None = None,
    **options,
) -> DataFrame:
    """Swapped amounts and fees per bucket."""
    return _series(
        "amounts", series.swap_volume_timeseries, swaps, block, resolution, from_height, to_height, offset,
        token_a, token_b, options,
    )


def _window(block: DataFrame, now: Column | int, last_completed: Column | int, length: int):
    """Heights of the last ``length`` seconds, and the offset of the day buckets that end now, to the minute."""
    now = now - now % 60 if isinstance(now, int) else floor_to_minute(as_column(now))
    if isinstance(now, int) and isinstance(last_completed, int):
        return *ranges.heights_now(block, now - length, now, last_completed), now % DAY
    low, high = ranges.resolve_heights(block, last_completed, after=as_column(now) - length, before=now)
    return low, high, day_offset(now)


def stats_price_24h(price, block, now, last_completed, token_a=None, token_b=None) -> DataFrame:
    """Open, high, low and close of the last 24 hours and of the 24 hours before."""
    low, high, offset = _window(block, now, last_completed, 48 * HOUR)
    return price_series(price, block, "day", low, high, offset, token_a, token_b)


def stats_volume_24h(swaps, block, now, last_completed, token_a=None, token_b=None) -> DataFrame:
    """Swapped amounts and fees in the same windows."""
    low, high, offset = _window(block, now, last_completed, 48 * HOUR)
    return volume_series(swaps, block, "day", low, high, offset, token_a, token_b)


def stats_tvl_24h(reserves, block, now, last_completed, token_a=None, token_b=None) -> DataFrame:
    """Last reserves in the same windows."""
    low, high, offset = _window(block, now, last_completed, 48 * HOUR)
    return tvl_series(reserves, block, "day", low, high, offset, token_a, token_b)


def volatility_closes(price, block, now, last_completed) -> DataFrame:
    """Closes of the last 21 whole days of every pair."""
    low, high, _ = _window(block, now, last_completed, 22 * DAY)
    return series.daily_close_asof(price_series(price, block, "day", low, high), now)


def stats_volatility(price, block, now, last_completed, strict: bool = True, token_a=None, token_b=None) -> DataFrame:
    """Annualised volatility of the last 10 days and of the 10 days before.

    The price is always taken token1-to-token0, so the result does not depend on the asked order.
    """
    chosen = price if token_a is None or token_b is None else series.of_pair(price, token_a, token_b)
    returns = series.daily_returns(volatility_closes(chosen, block, now, last_completed))
    return series.volatility(returns, now, strict)
