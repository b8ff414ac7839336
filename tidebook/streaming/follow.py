"""Follow the log: hold back the open block and advance derived state with each complete part."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.operators import changes as feeds
from tidebook.operators import state
from tidebook.operators.ordered import DEFAULT_SPAN
from tidebook.session import cut, no_rows
from tidebook.streaming.state_table import BatchOutput, StateTable

TICK_KEYS = "token0 string, token1 string, token_in string, tick int"
UPDATE = f"seq long, height long, {TICK_KEYS}, fee int, reserves decimal(38,0)"


class CompletedBlocks:
    """Hands on only complete blocks; rows of the newest block wait for a later block or the end of a poll.

    Derived state depends on the order of blocks, so a row of a block that was handed on before ends the stream with an
    error instead of changing what was derived from it.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str = UPDATE):
        self.received = BatchOutput(spark, f"{folder}/received", schema)
        self.handed_on = BatchOutput(spark, f"{folder}/handed-on", "height long")
        self.spark, self.schema = spark, schema

    def last_handed_on(self, batch: int) -> int:
        """Newest height handed on by the batches below ``batch``, -1 before the first."""
        return -1 if batch <= 0 else self.handed_on.of(batch - 1).first()[0]

    def _waiting(self, batch: int) -> DataFrame:
        if batch <= 0:
            return no_rows(self.spark, self.schema)
        return self.received.of(batch - 1).where(F.col("height") > self.last_handed_on(batch))

    def complete(self, rows: DataFrame, batch: int) -> DataFrame:
        """Complete rows of this batch, with those that waited; at most one block of rows is held back.

        The rows are evaluated once: they are written, and bounds, result and what waits are read from that. Rows of
        batches that cannot run again are deleted.
        """
        found = self.received.write(batch, rows.unionByName(self._waiting(batch)))
        lowest, newest = found.agg(F.min("height"), F.max("height")).first()
        done = self.last_handed_on(batch)
        if lowest is not None and lowest <= done:
            self.received.remove(batch)
            raise ValueError(f"rows of block {lowest} arrived after block {done} was handed on")
        limit = -1 if newest is None else newest
        upto = max(done, limit - 1)
        self.handed_on.write(batch, self.spark.range(upto, upto + 1, numPartitions=1).toDF("height"))
        self.received.remove(batch - 2)
        return found.where(F.col("height") < limit)

    def rest(self, batch: int) -> DataFrame:
        """Rows still waiting after the batches below ``batch``, for the end of a poll."""
        return self._waiting(batch)


def _newest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.max_by(v, "seq").alias(v) for v in values])


class TickBook:
    """Reserve changes, tick state, reserve totals, best prices and tick frames, advanced batch by batch.

    Each batch runs the batch operators over its own rows, started from the stored state of the keys it touches. Hot
    pairs are split inside a batch exactly as in a full run.
    """

    OUTPUTS = {
        "tick_update": f"{UPDATE}, reserves_diff decimal(38,0)",
        "tick_state": "token0 string, token1 string, token string, tick int, fee int, reserves decimal(38,0), "
        "height long, seq long",
        "reserves": "seq long, height long, token0 string, token1 string, reserves0 decimal(38,0), "
        "reserves1 decimal(38,0), seen0 long, seen1 long",
        "price": "seq long, height long, token0 string, token1 string, best0 int, best1 int, last int",
        "frames": "token0 string, token1 string, token string, tick int, height long, reserves decimal(38,0)",
    }

    def __init__(self, spark: SparkSession, folder: str, span: int = DEFAULT_SPAN, compact_every: int = 20):
        self.span = span
        self.outputs = {n: BatchOutput(spark, f"{folder}/out/{n}", s) for n, s in self.OUTPUTS.items()}

        def table(name: str, keys: list[str], schema: str) -> StateTable:
            return StateTable(spark, f"{folder}/state/{name}", keys, schema, compact_every)

        pair = "token0 string, token1 string"
        self.marks = table("marks", state.TICK, f"{TICK_KEYS}, reserves decimal(38,0)")
        self.ticks = table("ticks", state.STATE, f"{TICK_KEYS}, fee int, reserves decimal(38,0)")
        self.totals = table(
            "totals", state.PAIR, f"{pair}, reserves0 decimal(38,0), reserves1 decimal(38,0), seen0 long, seen1 long"
        )
        self.best = table("best", state.PAIR, f"{pair}, best0 int, best1 int, given0 boolean, given1 boolean")

    def advance(self, updates: DataFrame, batch: int) -> None:
        """Derive and store everything that follows from the new tick updates."""
        # read by four tables, and the ticks by three outputs; before the first batch there is no state
        touched = cut(updates.select(*state.PAIR).distinct()) if batch > 0 else None

        def of_touched(table: StateTable) -> DataFrame:
            return table.before(batch) if touched is None else table.before(batch).join(touched, state.PAIR, "left_semi")

        ticks, span = of_touched(self.ticks), self.span
        if batch > 0:
            ticks = cut(ticks)
        # the changes of one batch, read by four outputs
        changes = cut(state.state_changes(updates, span, carry=ticks))

        def reserve_changes() -> None:
            diffs = state.reserves_diff(updates, span=span, carry=of_touched(self.marks))
            stored = self.outputs["tick_update"].write(batch, diffs)
            self.marks.write(batch, _newest(stored, state.TICK, ["reserves"]))

        def tick_state() -> None:
            versions = self.outputs["tick_state"].write(batch, state.versions_of_changes(changes))
            self.ticks.write(batch, _newest(versions.withColumnRenamed("token", "token_in"), state.STATE, ["reserves"]))

        def reserve_totals() -> None:
            totals = state.reserves_of_changes(changes, span, of_touched(self.totals), exact=True)
            stored = self.outputs["reserves"].write(batch, totals)
            self.totals.write(batch, _newest(stored, state.PAIR, state.TOTALS))

        def best_prices() -> None:
            price = state.best_price_of_changes(changes, span, ticks, of_touched(self.best))
            stored = self.outputs["price"].write(batch, price)
            newest = _newest(stored, state.PAIR, ["best0", "best1"])
            self.best.write(batch, newest.withColumns({"given0": F.lit(True), "given1": F.lit(True)}))

        def tick_frames() -> None:
            before = ticks.withColumnRenamed("token_in", "token").groupBy(*feeds.TICK)
            summed = before.agg(F.sum("reserves").cast("decimal(38,0)").alias("change"))
            self.outputs["frames"].write(batch, feeds.tick_changes(changes, span, summed))

        # the outputs depend on stored state of earlier batches only, so their jobs run side by side
        with ThreadPoolExecutor(5) as pool:
            steps = [pool.submit(s) for s in (reserve_changes, tick_state, reserve_totals, best_prices, tick_frames)]
            for step in steps:
                step.result()

    def read(self, name: str) -> DataFrame:
        """One output over all batches so far."""
        return self.outputs[name].read()


class ReservesDiff:
    """Reserve changes only, advanced batch by batch."""

    def __init__(self, spark: SparkSession, folder: str, span: int = DEFAULT_SPAN, compact_every: int = 20):
        self.span = span
        self.output = BatchOutput(spark, f"{folder}/out/tick_update", TickBook.OUTPUTS["tick_update"])
        self.marks = StateTable(
            spark, f"{folder}/state/marks", state.TICK, f"{TICK_KEYS}, reserves decimal(38,0)", compact_every
        )

    def advance(self, updates: DataFrame, batch: int) -> None:
        touched = updates.select(*state.PAIR).distinct()
        carry = self.marks.before(batch).join(touched, state.PAIR, "left_semi")
        diffs = self.output.write(batch, state.reserves_diff(updates, span=self.span, carry=carry))
        self.marks.write(batch, _newest(diffs, state.TICK, ["reserves"]))

    def read(self) -> DataFrame:
        return self.output.read()


def follow(
    updates: DataFrame,
    advance: Callable[[DataFrame, int], None],
    gate: CompletedBlocks,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "500 milliseconds",
) -> StreamingQuery:
    """Run ``advance`` on the complete blocks of every micro-batch of a stream of tick updates."""

    def step(rows: DataFrame, batch: int) -> None:
        advance(gate.complete(rows, batch), batch)

    writer = updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def finish(advance: Callable[[DataFrame, int], None], gate: CompletedBlocks, batches: int) -> None:
    """End of a poll: the block that still waits is complete as well. ``batches`` is the number already run."""
    advance(gate.rest(batches), batches)
