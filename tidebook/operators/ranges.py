"""Block ranges, time ranges and as-of lookups.

Lookups by a single height or time return one-row DataFrames; used as scalar subqueries they become literal scan
filters at run time. The ``_bulk`` forms answer many lookups with one merge of both sides in chunks of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import as_column, time_bucket
from tidebook.operators.ordered import last_known, next_known
from tidebook.sources.tables import RANGE, in_folders, without_folders


def check_range(from_height, to_height, allow_equal: bool = True) -> bool:
    """Validate plain numbers. Returns whether the range can hold rows."""
    numbers = [h for h in (from_height, to_height) if isinstance(h, int)]
    if any(h < 0 for h in numbers):
        raise ValueError("heights must not be negative")
    if len(numbers) == 2 and to_height > 0:
        if to_height < from_height or (to_height == from_height and not allow_equal):
            raise ValueError("the height range is empty")
        return to_height > from_height
    return True


def block_range(
    df: DataFrame, from_height: Column | int = 0, to_height: Column | int | None = None, last_completed=None
) -> DataFrame:
    """Rows of ``from < height <= to``. Zero or negative means unset; ``to`` is at most the last completed height."""
    if isinstance(to_height, int) and to_height <= 0:
        to_height = None
    above = from_height if not isinstance(from_height, int) or from_height > 0 else None
    limits = [limit for limit in (to_height, last_completed) if limit is not None]
    numbers = [limit for limit in limits if isinstance(limit, int)]
    rows = in_folders(df, above, min(numbers) if numbers else limits[0] if limits else None)
    if above is not None:
        rows = rows.where(F.col("height") > as_column(above))
    for limit in limits:
        rows = rows.where(F.col("height") <= as_column(limit))
    return rows


def completed_blocks(df: DataFrame, end_of_input: bool = False) -> DataFrame:
    """Rows of complete blocks: a block is complete once a later one is seen, or at the end of the input."""
    if end_of_input:
        return df
    newest = df.agg(F.max("height").alias("height")).scalar()
    return df.where(F.col("height") < newest)


def last_block(block: DataFrame) -> DataFrame:
    """Height and time of the newest block."""
    return block.agg(F.max("height").alias("height"), F.max_by("time_unix", "height").alias("time_unix"))


def last_completed_height(block: DataFrame, end_of_input: bool = False) -> DataFrame:
    return completed_blocks(block, end_of_input).agg(F.max("height").alias("height"))


def time_at_or_before_height(block: DataFrame, height: Column | int) -> DataFrame:
    """Time of the last block at or before a height, 0 when there is none."""
    return block.where(F.col("height") <= as_column(height)).agg(
        F.coalesce(F.max_by("time_unix", "height"), F.lit(0).cast("long")).alias("time_unix")
    )


def time_after_height(block: DataFrame, height: Column | int) -> DataFrame:
    """Time of the first block after a height; past the last block, the last time plus one."""
    after = F.min_by("time_unix", F.when(F.col("height") > as_column(height), F.col("height")))
    past_end = F.when(as_column(height) > 0, F.max_by("time_unix", "height") + 1).otherwise(F.lit(0).cast("long"))
    return block.agg(F.coalesce(after, past_end, F.lit(0).cast("long")).alias("time_unix"))


def height_at_time(block: DataFrame, time_unix: Column | int) -> DataFrame:
    """Last height at or before a time, 0 when there is none."""
    return block.where(F.col("time_unix") <= as_column(time_unix)).agg(
        F.coalesce(F.max("height"), F.lit(0).cast("long")).alias("height")
    )


def completed_height_at_time(block: DataFrame, time_unix: Column | int, last_completed: Column | int) -> DataFrame:
    return height_at_time(block, time_unix).select(
        F.least(F.col("height"), as_column(last_completed).cast("long")).alias("height")
    )


def _asof_bulk(asked: DataFrame, known: DataFrame, on: str, value: str, span: int) -> DataFrame:
    # only distinct places are merged, so a place asked for very often is no heavier than any other;
    # known rows sort before asked rows of the same place
    left = asked.select(on).distinct().withColumn("_order", F.col(on) * 2 + 1).withColumn("_given", F.lit(False))
    right = known.select(on, value, (F.col(on) * 2).alias("_order"), F.lit(True).alias("_given"))
    merged = left.unionByName(right, allowMissingColumns=True).withColumn("_asked", ~F.col("_given"))
    filled = last_known(merged, [], "_order", {value: "_given"}, position=on, span=span)
    return asked.join(filled.where("_asked").select(on, value), on, "left")


def height_at_time_bulk(asked: DataFrame, block: DataFrame, span: int = 86400) -> DataFrame:
    """Add the last height at or before each row's ``time_unix``; 0 when there is none."""
    known = block.groupBy("time_unix").agg(F.max("height").alias("height"))
    found = _asof_bulk(asked, known, "time_unix", "height", span)
    return found.withColumn("height", F.coalesce("height", F.lit(0).cast("long")))


def time_at_height_bulk(asked: DataFrame, block: DataFrame, span: int = 4096) -> DataFrame:
    """Add the time of the last block at or before each row's ``height``; 0 when there is none."""
    found = _asof_bulk(asked, block.select("height", "time_unix"), "height", "time_unix", span)
    return found.withColumn("time_unix", F.coalesce("time_unix", F.lit(0).cast("long")))


def time_after_height_bulk(asked: DataFrame, block: DataFrame, span: int = 4096) -> DataFrame:
    """Add the time of the first block after each row's ``height``; past the last block, the last time plus one.

    Without any block, and for a height of 0 or less that no block is after, the time is 0. Rows without a height get
    null. Only distinct heights are looked up, so one that is asked for very often is no heavier than any other.
    """
    # an asked height sorts after the block of that height, so the next one given is the first block above it
    left = asked.select("height").where(F.col("height").isNotNull()).distinct().select(
        "height", (F.col("height") * 2 + 1).alias("_order"), F.lit(False).alias("_given")
    )
    right = block.select("height", "time_unix", (F.col("height") * 2).alias("_order"), F.lit(True).alias("_given"))
    merged = left.unionByName(right, allowMissingColumns=True).withColumn("_asked", ~F.col("_given"))
    filled = next_known(merged, [], "_order", {"time_unix": "_given"}, position="height", span=span)
    past_end = F.when(F.col("height") > 0, F.col("_last") + 1)
    last = block.agg(F.max_by("time_unix", "height").alias("time_unix")).scalar()
    found = (
        filled.where("_asked")
        .withColumn("_last", last)
        .select("height", F.coalesce("time_unix", past_end, F.lit(0).cast("long")).alias("time_unix"))
    )
    return asked.join(found, "height", "left")


def completed_height_at_time_bulk(
    asked: DataFrame, block: DataFrame, last_completed: Column | int, span: int = 86400
) -> DataFrame:
    """Add the last completed height at or before each row's ``time_unix``; 0 when there is none."""
    found = height_at_time_bulk(asked, block, span)
    return found.withColumn("height", F.least(F.col("height"), as_column(last_completed).cast("long")))


def resolve_heights(
    block: DataFrame,
    last_completed: Column | int,
    after: Column | int | None = None,
    before: Column | int | None = None,
    from_height: Column | int | None = None,
    to_height: Column | int | None = None,
) -> tuple[Column, Column]:
    """Range of heights from heights (first choice) or times, never past the last completed height."""
    last = as_column(last_completed).cast("long")

    def resolved(height, time, unset):
        if height is not None and not (isinstance(height, int) and height <= 0):
            return F.least(as_column(height).cast("long"), last)
        if time is not None:
            return completed_height_at_time(block, time, last_completed).scalar()
        return unset

    return resolved(from_height, after, F.lit(0).cast("long")), resolved(to_height, before, last)


def time_range(df: DataFrame, block: DataFrame, last_completed: Column | int, **limits) -> DataFrame:
    """Rows between two times, resolved to completed heights; see ``resolve_heights``."""
    low, high = resolve_heights(block, last_completed, **limits)
    return in_folders(df, low, high).where((F.col("height") > low) & (F.col("height") <= high))


def aligned_time_bounds(
    block: DataFrame,
    from_height: Column | int,
    to_height: Column | int,
    resolution: str = "minute",
    offset: Column | int = 0,
    align_bounds_to_offset: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Lower bound: the first block after ``from``, floored to its bucket. Upper: the last block up to ``to``.

    The floor ignores the bucket offset unless ``align_bounds_to_offset`` is set.
    """
    shift = offset if align_bounds_to_offset else 0
    low = time_after_height(block, from_height).select(time_bucket("time_unix", resolution, shift).alias("low"))
    high = time_at_or_before_height(block, to_height).select(F.col("time_unix").alias("high"))
    return low, high


def time_bounds_now(
    block: DataFrame,
    from_height: int,
    to_height: int,
    resolution: str = "minute",
    offset: int = 0,
    align_bounds_to_offset: bool = False,
) -> tuple[int, int]:
    """``aligned_time_bounds`` as two numbers, looked up in one pass over the block table."""
    height, none = F.col("height"), F.lit(0).cast("long")
    past_end = F.max_by("time_unix", "height") + 1 if from_height > 0 else none
    first = F.coalesce(F.min_by("time_unix", F.when(height > from_height, height)), past_end, none)
    last = F.coalesce(F.max_by("time_unix", F.when(height <= to_height, height)), none)
    found = block.agg(first.alias("first"), last.alias("last"))
    shift = offset if align_bounds_to_offset else 0
    row = found.select(time_bucket("first", resolution, shift), "last").first()
    return row[0], row[1]


def heights_now(block: DataFrame, after: int, before: int, last_completed: int) -> tuple[int, int]:
    """Completed heights at two times as numbers, looked up in one pass over the block table."""

    def at(time: int) -> Column:
        return F.max(F.when(F.col("time_unix") <= time, F.col("height")))

    row = block.agg(at(after), at(before)).first()
    return min(row[0] or 0, last_completed), min(row[1] or 0, last_completed)


def within_bounds(
    df: DataFrame,
    block: DataFrame,
    from_height: Column | int,
    to_height: Column | int,
    resolution: str,
    offset: Column | int = 0,
    align_bounds_to_offset: bool = False,
) -> DataFrame:
    """Rows inside the aligned time bounds; an empty height range keeps no row.

    Plain numbers are resolved first, so that the scan gets literal bounds; columns stay scalar subqueries.
    """
    if all(isinstance(x, int) for x in (from_height, to_height, offset)):
        if not check_range(from_height, to_height):
            return without_folders(df).where(F.lit(False))
        first, last = time_bounds_now(block, from_height, to_height, resolution, offset, align_bounds_to_offset)
        if RANGE in df.columns:  # block times grow with heights, so the bounds are a range of heights and of folders
            timed = block.where((F.col("time_unix") >= first) & (F.col("time_unix") <= last))
            low, high = timed.agg(F.min("height"), F.max("height")).first()
            df = in_folders(df, low, high) if low is not None else df.drop(RANGE).where(F.lit(False))
        return df.where((F.col("time_unix") >= first) & (F.col("time_unix") <= last))
    df = without_folders(df)
    holds = as_column(from_height) < as_column(to_height)
    low, high = aligned_time_bounds(block, from_height, to_height, resolution, offset, align_bounds_to_offset)
    return df.where(holds & (F.col("time_unix") >= low.scalar()) & (F.col("time_unix") <= high.scalar()))
