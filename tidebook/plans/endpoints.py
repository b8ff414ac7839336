"""The public queries as asked by a client: a pair in any order, a time or height range, one page.

``last_completed`` is the newest completed height; ``after``/``before`` are unix seconds and ``from_height``/``to_height``
take priority over them. Results come as one page in the documented order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators import liquidity, paging, ranges, series
from tidebook.plans import queries

SERIES_PAGE = 100
LIQUIDITY_PAGE = 10000


@dataclass
class Asked:
    """Range and page of a request; unset values mean everything up to the newest completed block."""

    last_completed: int
    after: int | None = None
    before: int | None = None
    from_height: int = 0
    to_height: int = 0
    offset: int = 0
    limit: int | None = None

    def heights(self, block: DataFrame) -> tuple[int, int]:
        """Completed heights of the range, as numbers; one pass over the block table when a time has to be found."""
        low = self.from_height if self.from_height > 0 else None
        high = self.to_height if self.to_height > 0 else None
        if (low is None and self.after) or (high is None and self.before):
            # a time before the first block gives height 0
            found = ranges.heights_now(block, self.after or 0, self.before or 0, self.last_completed)
            low = found[0] if low is None and self.after else low
            high = found[1] if high is None and self.before else high
        return min(low or 0, self.last_completed), min(
            self.last_completed if high is None else high, self.last_completed
        )


def _newest_first(rows: DataFrame, asked: Asked) -> DataFrame:
    return paging.paginate(rows, [F.desc("time_unix")], asked.offset, asked.limit, SERIES_PAGE)


def timeseries_price(price, block, token_a: str, token_b: str, asked: Asked, resolution: str = "minute") -> DataFrame:
    """Open, high, low, close per bucket, newest first."""
    low, high = asked.heights(block)
    rows = queries.price_series(price, block, resolution, low, high, 0, token_a, token_b)
    return _newest_first(rows.select("time_unix", "open", "high", "low", "close"), asked)


def timeseries_tvl(reserves, block, token_a: str, token_b: str, asked: Asked, resolution: str = "minute") -> DataFrame:
    """Last reserves of A and B per bucket, newest first."""
    low, high = asked.heights(block)
    rows = queries.tvl_series(reserves, block, resolution, low, high, 0, token_a, token_b)
    return _newest_first(
        rows.select("time_unix", F.col("amount0").alias("amount_a"), F.col("amount1").alias("amount_b")), asked
    )


def timeseries_volume(swaps, block, token_a: str, token_b: str, asked: Asked, resolution: str = "minute") -> DataFrame:
    """Swapped amounts and fees of A and B per bucket, newest first."""
    low, high = asked.heights(block)
    rows = queries.volume_series(swaps, block, resolution, low, high, 0, token_a, token_b)
    named = {"amount0": "amount_a", "amount1": "amount_b", "fee0": "fee_a", "fee1": "fee_b"}
    return _newest_first(rows.select("time_unix", *[F.col(c).alias(n) for c, n in named.items()]), asked)


def _sides(versions, token_a: str, token_b: str, asked: Asked) -> DataFrame:
    chosen = series.of_pair(versions, token_a, token_b)
    high = min(asked.to_height or asked.last_completed, asked.last_completed)
    rows = liquidity.pair_liquidity(chosen, max(asked.from_height, 0), high)
    return liquidity.orient_pair(rows, F.col("token0") == F.lit(token_b), "liquidity").select("side", "tick", "reserves")


def liquidity_pair(versions, token_a: str, token_b: str, asked: Asked) -> DataFrame:
    """Reserves by tick of A (side 0) and B (side 1), each side as its own page, middle ticks first.

    With ``from_height`` only ticks changed since, where zero reserves mean a removed tick.
    """
    rows = _sides(versions, token_a, token_b, asked)
    pages = [
        paging.paginate(rows.where(F.col("side") == side), [F.desc("tick")], asked.offset, asked.limit, LIQUIDITY_PAGE)
        for side in (0, 1)
    ]
    return pages[0].unionByName(pages[1])


def liquidity_token(versions, token_a: str, token_b: str, asked: Asked) -> DataFrame:
    """Reserves by tick of A only."""
    own = versions.where(F.col("token") == F.lit(token_a))
    rows = _sides(own, token_a, token_b, asked).drop("side")
    return paging.paginate(rows, [F.desc("tick")], asked.offset, asked.limit, LIQUIDITY_PAGE)


def liquidity_pairs(reserves, unit_prices, asked: Asked) -> DataFrame:
    """Pairs ranked by value; with ``from_height`` only rows that differ from the ranking at that height."""
    high = min(asked.to_height or asked.last_completed, asked.last_completed)
    rows = liquidity.pairs_liquidity(reserves, unit_prices, high, max(asked.from_height, 0))
    return paging.paginate(rows, [F.asc("rank")], asked.offset, asked.limit, LIQUIDITY_PAGE)


def stats_price(price, block, token_a: str, token_b: str, now: int, last_completed: int) -> DataFrame:
    return queries.stats_price_24h(price, block, now, last_completed, token_a, token_b).orderBy(F.desc("time_unix"))


def stats_tvl(reserves, block, token_a: str, token_b: str, now: int, last_completed: int) -> DataFrame:
    return queries.stats_tvl_24h(reserves, block, now, last_completed, token_a, token_b).orderBy(F.desc("time_unix"))


def stats_volume(swaps, block, token_a: str, token_b: str, now: int, last_completed: int) -> DataFrame:
    return queries.stats_volume_24h(swaps, block, now, last_completed, token_a, token_b).orderBy(F.desc("time_unix"))


def stats_volatility(price, block, token_a, token_b, now: int, last_completed: int, strict: bool = True) -> DataFrame:
    rows = queries.stats_volatility(price, block, now, last_completed, strict, token_a, token_b)
    return rows.select("time_unix", "volatility").orderBy(F.desc("time_unix"))
