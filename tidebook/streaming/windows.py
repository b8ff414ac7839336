"""Tumbling windows over streams, updated as blocks arrive.

What a trigger reads has to be later than what triggers before it read, as whole batches of a followed log are: the
watermark has no delay. A row that comes after its window was closed ends the stream with ``LateRows``; none is dropped in
silence. Aggregation is partial on the map side; a hot pair adds one small row per task and window to the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.streaming.state_table import BatchOutput

PAIR = ["token0", "token1"]


class LateRows(RuntimeError):
    """Rows came after their window was closed, so that results would lack them."""


def windowed(rows: DataFrame, size: str, offset: int = 0):
    """Group a stream with ``time_unix`` by pair and window."""
    timed = rows.withColumn("ts", F.timestamp_seconds("time_unix")).withWatermark("ts", "0 seconds")
    start = f"{offset} seconds" if offset else None
    return timed.groupBy(*PAIR, F.window("ts", size, startTime=start))


def _flat(grouped: DataFrame, values: list[str]) -> DataFrame:
    return grouped.select(*PAIR, F.unix_timestamp("window.start").alias("time_unix"), *values)


def ohlc_windows(price: DataFrame, size: str, offset: int = 0) -> DataFrame:
    priced = price.where(F.col("last").isNotNull())
    return _flat(
        windowed(priced, size, offset).agg(
            F.min_by("last", "seq").alias("open"),
            F.max("last").alias("high"),
            F.min("last").alias("low"),
            F.max_by("last", "seq").alias("close"),
        ),
        ["open", "high", "low", "close"],
    )


def tvl_windows(reserves: DataFrame, size: str, offset: int = 0) -> DataFrame:
    return _flat(
        windowed(reserves, size, offset).agg(
            F.max_by("reserves0", "seq").alias("amount0"), F.max_by("reserves1", "seq").alias("amount1")
        ),
        ["amount0", "amount1"],
    )


def volume_windows(swaps: DataFrame, size: str, offset: int = 0) -> DataFrame:
    """Swapped amounts and fees per window, in floating point: no amount can leave its range and end the stream."""
    change = F.col("reserves_diff").cast("double")

    def total(token: str, value: Column) -> Column:
        counts = (F.col("token_in") == F.col(token)) & (F.col("reserves_diff") > 0)
        return F.sum(F.when(counts, value).otherwise(F.lit(0.0)))

    fee = change * F.col("fee").cast("double")
    sums = windowed(swaps, size, offset).agg(
        total("token0", change).alias("amount0"),
        total("token1", change).alias("amount1"),
        (total("token0", fee) / 10000).alias("fee0"),
        (total("token1", fee) / 10000).alias("fee1"),
    )
    return _flat(sums, ["amount0", "amount1", "fee0", "fee1"])


def write_updates(
    windows: DataFrame, folder: str, checkpoint: str, available_now: bool = False, interval: str = "500 milliseconds"
) -> tuple[StreamingQuery, BatchOutput]:
    """Write the windows changed by each batch; ``current_windows`` folds them.

    After a late row the next batch fails, and so does ``end``, which waits for the last one.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema)
    output = BatchOutput(windows.sparkSession, folder, schema)
    started: list[StreamingQuery] = []

    def step(rows: DataFrame, batch: int) -> None:
        if started:
            ensure_no_late_rows(started[0])
        output.write(batch, rows)

    writer = windows.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    started.append(writer.trigger(**trigger).start())
    return started[0], output


def ensure_no_late_rows(query: StreamingQuery) -> None:
    """Raise ``LateRows`` when a window has missed rows."""
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    if late:
        raise LateRows(f"{late} groups of rows came after their window was closed")


def end(query: StreamingQuery) -> None:
    """Wait for the end of a query over what is there, and make sure that every row was counted."""
    query.awaitTermination()
    ensure_no_late_rows(query)


def current_windows(output: BatchOutput, having_amount: bool = False) -> DataFrame:
    """Newest content of every window; ``having_amount`` drops windows without a swapped amount."""
    rows = output.read()
    keys = [*PAIR, "time_unix"]
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])
    if having_amount:
        newest = newest.where((F.col("amount0") > 0) | (F.col("amount1") > 0))
    return newest
