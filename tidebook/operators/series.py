"""Time series: open/high/low/close, locked value, swap volume, daily closes and volatility.

Input rows carry ``time_unix``. All functions work for every pair at once, keyed by ``token0, token1``. Buckets are
plain aggregates, so a hot pair or bucket is reduced on the map side before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions import as_column, floor_to_day, tick_to_price, time_bucket
from tidebook.operators.ranges import within_bounds

PAIR = ["token0", "token1"]
DAY = 86400


def priced_only(price: DataFrame) -> DataFrame:
    """Drop rows without a last tick."""
    return price.where(F.col("last").isNotNull())


def of_pair(df: DataFrame, token_a: str, token_b: str) -> DataFrame:
    """Rows of one pair, named in either order."""
    a, b = F.lit(token_a), F.lit(token_b)
    return df.where(
        ((F.col("token0") == a) & (F.col("token1") == b)) | ((F.col("token0") == b) & (F.col("token1") == a))
    )


def _bucketed(df: DataFrame, resolution: str, offset: Column | int):
    return df.groupBy(*PAIR, time_bucket("time_unix", resolution, offset).alias("time_unix"))


def ohlc(price: DataFrame, resolution: str = "minute", offset: Column | int = 0) -> DataFrame:
    """Open, high, low and close of the last tick per pair and bucket."""
    return _bucketed(priced_only(price), resolution, offset).agg(
        F.min_by("last", "seq").alias("open"),
        F.max("last").alias("high"),
        F.min("last").alias("low"),
        F.max_by("last", "seq").alias("close"),
    )


def first_last_in_bucket(price: DataFrame, resolution: str = "minute", offset: Column | int = 0) -> DataFrame:
    """Add the first and last value of each row's bucket.

    Equals first_value/last_value over the whole bucket, but a bucket is reduced before it is joined back, so no
    task has to hold one.
    """
    rows = priced_only(price).withColumn("bucket", time_bucket("time_unix", resolution, offset))
    ends = rows.groupBy(*PAIR, "bucket").agg(
        F.min_by("last", "seq").alias("first_price"), F.max_by("last", "seq").alias("last_price")
    )
    return rows.join(ends, [*PAIR, "bucket"])


def tvl_timeseries(reserves: DataFrame, resolution: str = "minute", offset: Column | int = 0) -> DataFrame:
    """Last reserves of both sides per pair and bucket."""
    return _bucketed(reserves, resolution, offset).agg(
        F.max_by("reserves0", "seq").alias("amount0"), F.max_by("reserves1", "seq").alias("amount1")
    )


def swap_volume_timeseries(swaps: DataFrame, resolution: str = "minute", offset: Column | int = 0) -> DataFrame:
    """Per pair and bucket: positive reserve changes and their fees, per side; buckets without an amount are dropped.

    ``swaps`` are tick updates with ``reserves_diff`` that belong to limit-order messages. Sums are exact per fee tier
    and become floating point when tiers are multiplied and added, so that no product can leave the range of exact
    numbers; a tier whose exact sum would, is summed in floating point. A missing fee is skipped by the fee sum only.
    """
    change = F.col("reserves_diff")

    def of_side(token: str) -> list[Column]:
        counted = F.when((F.col("token_in") == F.col(token)) & (change > 0), change)
        exact = F.try_sum(counted.cast("decimal(38,0)")).cast("double")
        total = F.coalesce(exact, F.sum(counted.cast("double")), F.lit(0.0))
        return [total.alias(f"of_{token}"), (F.count(counted) < F.count("*")).alias(f"others_{token}")]

    tiers = swaps.groupBy(*PAIR, time_bucket("time_unix", resolution, offset).alias("time_unix"), "fee").agg(
        *of_side("token0"), *of_side("token1")
    )

    def fees(token: str) -> Column:
        # a side with nothing but swaps of an unknown fee has an unknown sum
        known = F.when(F.col("fee").isNotNull(), F.col(f"of_{token}") * F.col("fee").cast("double"))
        return F.sum(known.when(F.col(f"others_{token}"), F.lit(0.0))) / 10000

    sums = tiers.groupBy(*PAIR, "time_unix").agg(
        F.sum("of_token0").alias("total0"), F.sum("of_token1").alias("total1"), fees("token0").alias("fee0"), fees("token1").alias("fee1")
    )
    return sums.where((F.col("total0") > 0) | (F.col("total1") > 0)).select(
        *PAIR, "time_unix", F.col("total0").alias("amount0"), F.col("total1").alias("amount1"), "fee0", "fee1"
    )


def ranged(df: DataFrame, block: DataFrame, from_height, to_height, resolution: str, offset=0, **options) -> DataFrame:
    """The part of a timed input that belongs to the buckets of a height range."""
    return within_bounds(df, block, from_height, to_height, resolution, offset, **options)


def daily_close_asof(daily: DataFrame, now: Column | int, days: int = 21) -> DataFrame:
    """Close of each of the last whole days: the newest bucket at or before the start of the day.

    ``daily`` holds one row per pair and day. Output: pair, ``day`` (1 = yesterday), ``time_unix``, ``close``; days
    before the first bucket have no row.
    """
    today = floor_to_day(as_column(now))
    spine = (
        daily.groupBy(*PAIR)
        .agg(F.lit(True).alias("_asked"))
        .select(*PAIR, "_asked", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
        .withColumn("time_unix", today - F.col("day") * DAY)
    )
    merged = daily.select(*PAIR, "time_unix", "close").unionByName(spine, allowMissingColumns=True)
    # one row per day and pair: the window of a pair holds at most days + range rows
    upto = (
        W.partitionBy(*PAIR)
        .orderBy("time_unix", F.col("_asked").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        merged.withColumn("close", F.last("close", ignorenulls=True).over(upto))
        .where(F.col("_asked") & F.col("close").isNotNull())
        .select(*PAIR, "day", "time_unix", "close")
    )


def daily_returns(closes: DataFrame) -> DataFrame:
    """Relative change of each day's close against the day before; missing ones close up. Newest is ``position`` 1."""
    by_day = W.partitionBy(*PAIR).orderBy("day")
    price = tick_to_price(F.col("close"))
    changes = (
        closes.withColumn("_price", price)
        .withColumn("_before", F.lead("_price").over(by_day))
        .withColumn("_day_before", F.lead("day").over(by_day))
        .where(F.col("_day_before") == F.col("day") + 1)
    )
    return changes.select(
        *PAIR,
        F.row_number().over(by_day).alias("position"),
        (F.col("_price") / F.col("_before") - 1).alias("change"),
    )


def sample_stddev(df: DataFrame, by: list[str], value: str, population: bool = False) -> DataFrame:
    """Standard deviation per group, of a sample unless ``population`` is set."""
    measure = F.stddev_pop(value) if population else F.stddev_samp(value)
    return df.groupBy(*by).agg(measure.alias("stddev"))


def volatility(returns: DataFrame, now: Column | int, strict: bool = True) -> DataFrame:
    """Annualised volatility of the newest 10 returns and of the 10 before; too short periods have no row."""
    today = floor_to_day(as_column(now))

    def period(first: int):
        inside = F.col("position").between(first, first + 9)
        return F.stddev_samp(F.when(inside, F.col("change"))) * F.sqrt(F.lit(252.0))

    both = returns.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("_n"), period(1).alias("_newest"), period(11).alias("_before")
    )
    periods = F.array(
        F.struct(F.lit(10).alias("days"), F.col("_newest").alias("volatility")),
        F.struct(F.lit(20).alias("days"), F.col("_before").alias("volatility")),
    )
    rows = both.select(*PAIR, "_n", F.explode(periods).alias("p"))
    if strict:
        rows = rows.where(F.col("_n") >= F.col("p.days"))
    return rows.select(
        *PAIR, (today - F.col("p.days") * DAY).alias("time_unix"), F.col("p.volatility").alias("volatility")
    )
