"""Change feeds: frames of changed rows per block, repeats, and folding changes back into state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.ordered import CHUNK, DEFAULT_SPAN, previous_value, running_sum
from tidebook.operators.ranges import block_range

TICK = ["token0", "token1", "token", "tick"]


def tick_changes(changes: DataFrame, span: int = DEFAULT_SPAN, carry: DataFrame | None = None) -> DataFrame:
    """One row per tick and block in which it changed, with its reserves over all fees after that block.

    ``changes`` is the state change log. Zero reserves mean that the tick is gone. ``carry`` has the tick's reserves
    before this input as ``change``.
    """
    keyed = changes.select(
        "seq", "height", "token0", "token1", F.col("token_in").alias("token"), "tick", "change"
    )
    summed = running_sum(keyed, TICK, "seq", {"reserves": "change"}, span=span, carry=carry)
    return summed.groupBy(*TICK, "height").agg(F.max_by("reserves", "seq").alias("reserves"))


def changes_since(frames: DataFrame, from_height, to_height=None) -> DataFrame:
    """The frames of the blocks in ``(from, to]``: one frame per height with changed rows."""
    return block_range(frames, from_height, to_height)


def accumulate_changes(frames: DataFrame, keys: list[str], order: str = "height", value: str = "reserves") -> DataFrame:
    """Fold frames into current state: the newest row of a key stays, a zero removes it."""
    values = [c for c in frames.columns if c not in (*keys, order)]
    folded = frames.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in values])
    return folded.where(F.col(value) != 0)


def frame_digests(rows: DataFrame, frame: list[str], order: str) -> DataFrame:
    """Size and digest of each frame; two frames have equal digests when they hold equal rows at equal places.

    The digest adds up two independent 64-bit hashes per row, so a frame of any size is reduced on the map side.
    """
    content = [c for c in rows.columns if c not in (*frame, order)]
    wide = "decimal(38,0)"
    return rows.groupBy(*frame, order).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*content).cast(wide)).cast(wide).alias("_a"),
        F.sum(F.xxhash64(F.lit("second"), *content).cast(wide)).cast(wide).alias("_b"),
    )


def suppress_repeats(
    rows: DataFrame, heights: DataFrame, feed: list[str], span: int = DEFAULT_SPAN
) -> DataFrame:
    """Kind of each frame of a feed: ``heartbeat`` when it is empty or repeats the last one sent, else ``update``.

    ``rows`` holds the frame rows with ``height`` and the feed's key columns, ``heights`` the frames due per feed.
    """
    digests = frame_digests(rows, feed, "height")
    sent = digests.withColumn(
        "digest", F.concat_ws(":", F.col("rows").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))
    )
    compared = previous_value(sent, feed, "height", "digest", "_last", span=span).drop(CHUNK)
    kinds = compared.select(
        *feed,
        "height",
        "rows",
        F.when(F.col("digest").eqNullSafe(F.col("_last")), F.lit("heartbeat")).otherwise(F.lit("update")).alias("kind"),
    )
    return heights.select(*feed, "height").join(kinds, [*feed, "height"], "left").select(
        *feed,
        "height",
        F.coalesce("kind", F.lit("heartbeat")).alias("kind"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )
