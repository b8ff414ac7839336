"""Liquidity by tick, and pairs ranked by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import as_column, round_significant
from tidebook.functions.wide import total
from tidebook.operators.ordered import number_rows
from tidebook.operators.ranges import block_range, check_range
from tidebook.operators.state import latest_tick_state, live_ticks

PAIR = ["token0", "token1"]
TICK = [*PAIR, "token", "tick"]


def ticks_changed(rows: DataFrame, versions: DataFrame, from_height, to_height=None) -> DataFrame:
    """Keep ticks that have a version in ``(from, to]``."""
    touched = block_range(versions, from_height, to_height).select(*TICK).distinct()
    return rows.join(touched, TICK, "left_semi")


def tick_liquidity(versions: DataFrame, from_height: Column | int = 0, to_height: Column | int | None = None) -> DataFrame:
    """Reserves per pair, token and tick, summed over fees.

    From height 0 it is a snapshot of live ticks; from a later height it holds the ticks changed since, where zero
    reserves mean a removed tick. ``tick`` is negated, ``reserves`` has 3 significant digits.
    """
    check_range(from_height, to_height, allow_equal=False)
    latest = latest_tick_state(versions, 0, to_height)
    if isinstance(from_height, int) and from_height <= 0:
        kept = live_ticks(latest)
    else:
        kept = ticks_changed(latest, versions, from_height, to_height)
    return kept.groupBy(*TICK).agg(total(kept, "reserves").alias("reserves")).select(
        *PAIR, "token", (-F.col("tick")).alias("tick"), round_significant(F.col("reserves"), 3).alias("reserves")
    )


def pair_liquidity(versions: DataFrame, from_height=0, to_height=None) -> DataFrame:
    """Both sides of every stored pair: ``side`` 0 holds the first token's reserves."""
    side = F.when(F.col("token") == F.col("token0"), 0).otherwise(1)
    return tick_liquidity(versions, from_height, to_height).select(*PAIR, side.alias("side"), "tick", "reserves")


def token_liquidity(versions: DataFrame, from_height=0, to_height=None) -> DataFrame:
    """First side of every stored pair only."""
    own = versions.where(F.col("token") == F.col("token0"))
    return pair_liquidity(own, from_height, to_height).drop("side")


def orient_pair(df: DataFrame, inverted: Column | bool, kind: str) -> DataFrame:
    """Turn stored pair order into the asked order.

    ``price`` negates ticks and swaps high and low, ``amounts`` swaps the columns of both sides, ``liquidity`` swaps
    the side number (ticks are already in terms of their own side).
    """
    turn = as_column(inverted)

    def swap(a: str, b: str) -> dict[str, Column]:
        return {
            a: F.when(turn, F.col(b)).otherwise(F.col(a)),
            b: F.when(turn, F.col(a)).otherwise(F.col(b)),
        }

    if kind == "price":
        return df.withColumns(
            {
                "open": F.when(turn, -F.col("open")).otherwise(F.col("open")),
                "close": F.when(turn, -F.col("close")).otherwise(F.col("close")),
                "high": F.when(turn, -F.col("low")).otherwise(F.col("high")),
                "low": F.when(turn, -F.col("high")).otherwise(F.col("low")),
            }
        )
    if kind == "amounts":
        columns = swap("amount0", "amount1")
        if "fee0" in df.columns:
            columns |= swap("fee0", "fee1")
        return df.withColumns(columns)
    if kind == "liquidity":
        return df.withColumn("side", F.when(turn, 1 - F.col("side")).otherwise(F.col("side")))
    raise ValueError(f"unknown kind: {kind}")


def latest_reserves_per_pair(reserves: DataFrame, from_height=0, to_height=None) -> DataFrame:
    """Newest reserves of each pair in ``(from, to]``."""
    return (
        block_range(reserves, from_height, to_height)
        .groupBy(*PAIR)
        .agg(F.max_by("reserves0", "seq").alias("reserves0"), F.max_by("reserves1", "seq").alias("reserves1"))
    )


def price_enrich(pairs: DataFrame, unit_prices: DataFrame) -> DataFrame:
    """Add the value of both sides; ``unit_prices`` has ``token, unit_price``, and a missing price counts as 0."""
    def priced(side: int) -> DataFrame:
        return unit_prices.select(
            F.col("token").alias(f"token{side}"), F.col("unit_price").alias(f"price{side}")
        )

    joined = pairs.join(priced(0), "token0", "left").join(priced(1), "token1", "left")
    nothing = F.lit(0.0)
    return joined.withColumn("price0", F.coalesce("price0", nothing)).withColumn(
        "price1", F.coalesce("price1", nothing)
    ).withColumn("value", F.col("reserves0") * F.col("price0") + F.col("reserves1") * F.col("price1"))


def rank_pairs(valued: DataFrame) -> DataFrame:
    """Place after sorting by value, from 1; equal values are ordered by token names."""
    return number_rows(valued, [F.desc("value"), F.asc("token0"), F.asc("token1")], "rank")


def pairs_liquidity(reserves: DataFrame, unit_prices: DataFrame, to_height=None, from_height=0) -> DataFrame:
    """Pairs ranked by value with rounded reserves; the value itself stays hidden.

    With ``from_height`` only the rows that differ from the ranking at that height.
    """
    def ranking(upto) -> DataFrame:
        ranked = rank_pairs(price_enrich(latest_reserves_per_pair(reserves, 0, upto), unit_prices))
        return ranked.select(
            "rank",
            *PAIR,
            round_significant(F.col("reserves0"), 4).alias("reserves0"),
            round_significant(F.col("reserves1"), 4).alias("reserves1"),
        )

    current = ranking(to_height)
    if isinstance(from_height, int) and from_height <= 0:
        return current
    return rows_not_in(current, ranking(from_height))


def rows_not_in(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of the first input that are not in the second, compared on the whole row; nulls are equal."""
    same = None
    now, before = current.alias("now"), previous.alias("before")
    for column in current.columns:
        equal = F.col(f"now.{column}").eqNullSafe(F.col(f"before.{column}"))
        same = equal if same is None else same & equal
    return now.join(before, same, "left_anti")
