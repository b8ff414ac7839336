"""State derived from tick updates: reserve changes, tick state, best prices and reserve totals.

Input rows of every function here are tick updates with ``seq, height, token0, token1, token_in, tick, fee,
reserves``. Extra columns pass through. ``reserves`` is an exact decimal, or limbs of ``functions.wide`` for numbers of more
digits; changes and exact totals then are limbs as well, and so must be what is carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions import amount_difference
from tidebook.functions.wide import (
    from_limb_columns,
    is_positive,
    is_wide,
    limb_columns,
    total,
    wide_difference,
    wide_text,
    wide_zero,
)
from tidebook.operators.ordered import (
    CHUNK,
    CHUNK_LEVELS,
    DEFAULT_SPAN,
    last_known,
    previous_value,
    running_sum,
)
from tidebook.operators.ranges import block_range
from tidebook.schemas import AMOUNT
from tidebook.session import cut

def _zero(wide: bool) -> Column:
    return wide_zero() if wide else F.lit(0).cast(AMOUNT)


def _difference(current: Column, previous: Column, wide: bool) -> Column:
    return wide_difference(current, previous) if wide else amount_difference(current, previous)


def _live(value: Column, wide: bool) -> Column:
    return is_positive(value) if wide else value > 0


PAIR = ["token0", "token1"]
TICK = [*PAIR, "token_in", "tick"]
STATE = [*TICK, "fee"]
SIDE = [*PAIR, "side"]
RESERVES = ["reserves0", "reserves1"]
TOTALS = [*RESERVES, "seen0", "seen1"]


def reserves_diff(
    updates: DataFrame, by_fee: bool = False, span: int = DEFAULT_SPAN, carry: DataFrame | None = None
) -> DataFrame:
    """Exact change of a tick's reserves since its previous update; unchanged rows are dropped.

    The previous update is looked up without the fee unless ``by_fee`` is set.
    """
    keys = STATE if by_fee else TICK
    wide = is_wide(updates, "reserves")
    given = updates.withColumn("reserves", F.coalesce("reserves", _zero(wide)))
    return (
        previous_value(given, keys, "seq", "reserves", "_previous", span=span, carry=carry)
        .withColumn("reserves_diff", _difference(F.col("reserves"), F.col("_previous"), wide))
        .where(F.col("reserves_diff") != _zero(wide))
        .drop("_previous", CHUNK)
    )


def state_changes(updates: DataFrame, span: int = DEFAULT_SPAN, carry: DataFrame | None = None) -> DataFrame:
    """Updates that set a new value for their (pair, token, tick, fee), with the change and the chunk."""
    changed = previous_value(updates, STATE, "seq", "reserves", "previous", span=span, carry=carry)
    return changed.where(~F.col("reserves").eqNullSafe(F.col("previous"))).withColumn(
        "change", _difference(F.col("reserves"), F.col("previous"), is_wide(updates, "reserves"))
    )


def tick_state_versions(
    updates: DataFrame, span: int = DEFAULT_SPAN, carry: DataFrame | None = None
) -> DataFrame:
    """One version per (pair, token, tick, fee, height): the last change of the key in the block."""
    return versions_of_changes(state_changes(updates, span, carry))


def versions_of_changes(changes: DataFrame) -> DataFrame:
    # grouping by the chunk as well keeps the partitioning of the change log, so this adds no shuffle
    return (
        changes.groupBy(*STATE, CHUNK, "height")
        .agg(F.max_by("reserves", "seq").alias("reserves"), F.max("seq").alias("seq"))
        .select(*PAIR, F.col("token_in").alias("token"), "tick", "fee", "reserves", "height", "seq")
    )


def reserves_series(
    updates: DataFrame, span: int = DEFAULT_SPAN, carry: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Live reserve totals of both sides of a pair after each change of a total.

    The change log feeds two branches of the plan, which share its shuffle. A stored change log can be given to
    ``reserves_of_changes`` instead.
    """
    changes = state_changes(updates, span, carry).select(*STATE, "seq", "height", "previous", "change")
    return reserves_of_changes(changes, span, totals)


def reserves_of_changes(
    changes: DataFrame, span: int = DEFAULT_SPAN, totals: DataFrame | None = None, exact: bool = False
) -> DataFrame:
    """Rows where a side's total changes, and the first change of each side even when its total is 0.

    A total is the running sum of the side's changes, so the state is never scanned again. ``totals`` carries
    ``reserves0, reserves1, seen0, seen1`` per pair; ``exact`` keeps these columns as they are.
    """
    first = F.col("token_in") == F.col("token0")
    wide = is_wide(changes, "change")
    zero = _zero(wide)
    changed = F.col("change") != zero
    # a side's first change is the first of its key, so all other unchanged totals can go before the sum
    moved = changes.where(changed | F.col("previous").isNull()).select(
        "seq",
        "height",
        *PAIR,
        changed.alias("_moved"),
        first.alias("_first"),
        *side_changes(first, zero),
    )
    sums = TOTALS
    if wide:
        moved, sums = _limbs_apart(moved)
        totals = None if totals is None else _limbs_apart(totals)[0]
    series = running_sum(moved, PAIR, "seq", {c: c for c in sums}, span=span, carry=totals)
    if wide:
        series = series.withColumns({c: from_limb_columns(c) for c in RESERVES})
    opening = F.when(F.col("_first"), F.col("seen0")).otherwise(F.col("seen1")) == 1
    kept = series.where(F.col("_moved") | opening)
    if exact:
        return kept.select("seq", "height", *PAIR, *TOTALS)
    double = lambda c: (wide_text(F.col(c)) if wide else F.col(c)).cast("double").alias(c)
    return kept.select("seq", "height", *PAIR, *[double(c) for c in RESERVES])


def side_changes(first: Column, zero: Column) -> list[Column]:
    """What a change adds to the totals of its pair, in the order of ``TOTALS``."""
    return [
        F.when(first, F.col("change")).otherwise(zero).alias("reserves0"),
        F.when(first, zero).otherwise(F.col("change")).alias("reserves1"),
        F.when(first, 1).otherwise(0).cast("long").alias("seen0"),
        F.when(first, 0).otherwise(1).cast("long").alias("seen1"),
    ]


def _limbs_apart(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with one column per limb of the totals, and the columns to add up."""
    apart = {name: limb for c in RESERVES for name, limb in limb_columns(rows, c).items()}
    return rows.withColumns(apart).drop(*RESERVES), [*apart, "seen0", "seen1"]


def summed_totals(rows: DataFrame) -> DataFrame:
    """The totals of each pair from rows that add to them."""
    wide = is_wide(rows, "reserves0")
    apart, sums = _limbs_apart(rows) if wide else (rows, TOTALS)
    kinds = {c: apart.schema[c].dataType for c in sums}
    found = apart.groupBy(*PAIR).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums])
    if wide:
        found = found.withColumns({c: from_limb_columns(c) for c in RESERVES})
    return found.select(*PAIR, *TOTALS)


def best_price_series(
    updates: DataFrame,
    span: int = DEFAULT_SPAN,
    carry: DataFrame | None = None,
    best: DataFrame | None = None,
) -> DataFrame:
    """Best live tick of both sides of a pair after each change of a best tick, in token1-to-token0 terms.

    ``last`` is the best tick of the side that changed, or of the other side when the changed one is empty.
    """
    # only the fact that a tick is live matters here, so no amounts are shuffled
    live = (F.col("reserves") > 0).cast("int").alias("live")
    known = None if carry is None else carry.select(*STATE, live)
    flags = updates.select(*STATE, "seq", "height", live)
    rows = previous_value(flags, STATE, "seq", "live", "was_live", span=span, carry=known)
    turns = _turns(rows.withColumn("was_live", F.coalesce("was_live", F.lit(0))))
    return _best_prices(turns, span, carry, best)


def best_price_of_changes(
    changes: DataFrame,
    span: int = DEFAULT_SPAN,
    carry: DataFrame | None = None,
    best: DataFrame | None = None,
) -> DataFrame:
    """The same from a stored change log."""
    return best_price_of_turns(live_turns(changes), span, carry, best)


def live_turns(changes: DataFrame) -> DataFrame:
    """The changes without their amounts: whether a tick is live after each and was before."""
    wide = is_wide(changes, "reserves")
    live = _live(F.col("reserves"), wide).cast("int").alias("live")
    was_live = F.coalesce(_live(F.col("previous"), wide), F.lit(False)).cast("int").alias("was_live")
    return changes.select(*STATE, CHUNK, "seq", "height", live, was_live)


def best_price_of_turns(
    rows: DataFrame, span: int = DEFAULT_SPAN, carry: DataFrame | None = None, best: DataFrame | None = None
) -> DataFrame:
    """The same from ``live_turns``. Of ``carry`` it only matters which ticks are live."""
    return _best_prices(_turns(rows), span, carry, best)


def _best_prices(turns: DataFrame, span: int, carry: DataFrame | None, best: DataFrame | None) -> DataFrame:
    moves = cut(best_tick_moves(turns, carry))
    first = F.col("side") == 0
    sided = moves.select(
        "seq",
        "height",
        *PAIR,
        "side",
        F.when(first, -F.col("best")).alias("best0"),
        F.when(~first, F.col("best")).alias("best1"),
        first.alias("given0"),
        (~first).alias("given1"),
    )
    filled = last_known(sided, PAIR, "seq", {"best0": "given0", "best1": "given1"}, span=span, carry=best)
    changed = F.when(first, F.col("best0")).otherwise(F.col("best1"))
    other = F.when(first, F.col("best1")).otherwise(F.col("best0"))
    return filled.select(
        "seq", "height", *PAIR, "best0", "best1", F.coalesce(changed, other).alias("last")
    )


def _turns(rows: DataFrame) -> DataFrame:
    """Rows where a (tick, fee) turns live or dead, numbered inside their chunk; three later branches read them."""
    inside = W.partitionBy(*STATE, CHUNK).orderBy("seq")
    return cut(
        rows.where(F.col("live") != F.col("was_live"))
        .withColumn("side", F.when(F.col("token_in") == F.col("token0"), 0).otherwise(1))
        .withColumn("step", F.col("live") - F.col("was_live"))
        .withColumn("turn", F.row_number().over(inside))
        .select(*SIDE, CHUNK, "tick", "fee", "seq", "height", "step", "turn")
    )


def best_tick_moves(turns: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Rows where the lowest live tick of a (pair, side) moves, with the new lowest tick (null: side is empty).

    The minimum is not invertible, so it needs an ordered pass over the turns. It runs per (pair, side, chunk); a
    chunk starts from two small summaries: the ticks it touches that were live before, and the lowest live tick among
    all those it leaves alone.
    """
    # a tick that first turns dead was live when the chunk began
    opening = F.when((F.col("turn") == 1) & (F.col("step") == -1), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(1))
    )
    steps = turns.select(*SIDE, CHUNK, "seq", "height", "tick", "step", F.explode(opening).alias("kind")).select(
        *SIDE,
        CHUNK,
        F.when(F.col("kind") == 1, F.col("seq")).otherwise(F.lit(-1)).alias("seq"),
        "height",
        "tick",
        F.when(F.col("kind") == 1, F.col("step")).otherwise(F.lit(1)).alias("step"),
    )
    untouched = _lowest_untouched(turns, carry).select(
        *SIDE,
        CHUNK,
        F.lit(-1).cast("long").alias("seq"),
        F.lit(-1).cast("long").alias("height"),
        "tick",
        F.lit(1).alias("step"),
    )
    return (
        steps.unionByName(untouched)
        .repartition(*SIDE, CHUNK)
        .sortWithinPartitions(*SIDE, CHUNK, "seq")
        .mapInPandas(_lowest_live_pass(), "seq long, height long, token0 string, token1 string, side int, best int")
    )


def _lowest_untouched(turns: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Lowest live tick of each active (pair, side, chunk) among the ticks without a turn in that chunk.

    Between two chunks that touch it, a live tick covers a range of chunks. Each range is cut into aligned
    power-of-two blocks (at most two per level), the minimum is taken per block, and a chunk looks up the blocks that
    hold it. The work grows with the turns times the levels, never with ticks times chunks.
    """
    tails = turns.groupBy(*SIDE, "tick", "fee", CHUNK).agg((F.max_by("step", "seq") > 0).alias("live"))
    if carry is not None:
        before = carry.select(
            *PAIR,
            F.when(F.col("token_in") == F.col("token0"), 0).otherwise(1).alias("side"),
            "tick",
            "fee",
            F.lit(-1).cast("long").alias(CHUNK),
            (F.col("reserves") > 0).alias("live"),
        )
        tails = tails.unionByName(before)
    end = F.lead(CHUNK).over(W.partitionBy(*SIDE, "tick", "fee").orderBy(CHUNK))
    limit = F.lit(1 << CHUNK_LEVELS).cast("long")
    ranges = tails.select(
        *SIDE, "tick", "live", (F.col(CHUNK) + 1).alias("a"), F.coalesce(end, limit).alias("b")
    ).where(F.col("live") & (F.col("a") < F.col("b")))

    def blocks_at(level):
        # the range in units of 2^level: rounded up at its start, rounded down at its end
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low = F.floor((F.col("a") + width - 1) / width)
        high = F.floor(F.col("b") / width)
        return F.array(
            F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("block"))),
            F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("block"))),
        )

    levels = F.sequence(F.lit(0), F.lit(CHUNK_LEVELS))
    blocks = F.filter(F.flatten(F.transform(levels, blocks_at)), lambda x: x.isNotNull())
    lowest = (
        ranges.select(*SIDE, "tick", F.explode(blocks).alias("at"))
        .groupBy(*SIDE, F.col("at.level").alias("level"), F.col("at.block").alias("block"))
        .agg(F.min("tick").alias("tick"))
    )
    active = turns.select(*SIDE, CHUNK).distinct()
    holders = active.select(
        *SIDE,
        CHUNK,
        F.explode(levels).alias("level"),
    ).withColumn("block", F.expr(f"shiftright({CHUNK}, level)"))
    return (
        holders.join(lowest, [*SIDE, "level", "block"])
        .groupBy(*SIDE, CHUNK)
        .agg(F.min("tick").alias("tick"))
    )


def _lowest_live_pass():
    """Ordered pass over sorted turns; memory holds one batch and the live ticks of the current chunk.

    It is a nested function so that it travels to the workers by value and they need no copy of this package.
    """
    columns = [*SIDE, CHUNK, "seq", "height", "tick", "step"]

    def lowest_live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = None
        counts: dict[int, int] = {}
        heap: list[int] = []
        best = None
        for batch in batches:
            moved = []
            for token0, token1, side, chunk, seq, height, tick, step in zip(*[batch[c].tolist() for c in columns]):
                if (token0, token1, side, chunk) != group:
                    group, counts, heap, best = (token0, token1, side, chunk), {}, [], None
                count = counts.get(tick, 0) + step
                counts[tick] = count
                if count == step == 1:
                    heapq.heappush(heap, tick)
                while heap and counts[heap[0]] <= 0:
                    heapq.heappop(heap)
                lowest = heap[0] if heap else None
                if lowest != best:
                    best = lowest
                    if seq >= 0:
                        moved.append((seq, height, token0, token1, side, lowest))
            out = pd.DataFrame(moved, columns=["seq", "height", "token0", "token1", "side", "best"])
            out["best"] = out["best"].astype("Int32")
            yield out

    return lowest_live


def latest_tick_state(versions: DataFrame, from_height=0, to_height=None) -> DataFrame:
    """Per (pair, token, tick, fee) the version with the greatest height in ``(from, to]``."""
    keys = [*PAIR, "token", "tick", "fee"]
    amounts = [c for c in ("reserves", "reserves_wide") if c in versions.columns]
    return (
        block_range(versions, from_height, to_height)
        .groupBy(*keys)
        .agg(*[F.max_by(c, "height").alias(c) for c in amounts], F.max("height").alias("height"))
    )


def is_live(state: DataFrame) -> Column:
    """Whether a tick of a table has reserves, of any size."""
    live = F.col("reserves") != 0
    return F.col("reserves_wide").isNotNull() | live if "reserves_wide" in state.columns else live


def live_ticks(state: DataFrame) -> DataFrame:
    return state.where(is_live(state))


def live_reserves_total(state: DataFrame) -> DataFrame:
    """Sum of live reserves per (pair, token)."""
    return live_ticks(state).groupBy(*PAIR, "token").agg(total(state, "reserves").alias("reserves"))


def best_tick(state: DataFrame) -> DataFrame:
    """Lowest live tick per (pair, token)."""
    return live_ticks(state).groupBy(*PAIR, "token").agg(F.min("tick").alias("tick"))


def upsert_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-replace on a unique key: the last write of a key stays."""
    values = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values]
    )
