"""Registered streaming queries: the driver's events arrive part by part and are followed to their end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from checks.queries import Inputs, register
from tidebook.operators import events
from tidebook.session import new_folder, stored
from tidebook.sources.tx_log import stream_tx_log as open_stream
from tidebook.sources.versions import rename_once
from tidebook.streaming import windows
from tidebook.streaming.follow import UPDATE, CompletedBlocks, ReservesDiff, TickBook, finish, follow
from tidebook.streaming.log import LogBook

#: Rows of an arrival; a small table still arrives in several parts.
ARRIVAL_ROWS = 5_000_000
FEWEST_ARRIVALS = 4
PART = "batch"


def arrivals(rows: DataFrame, folder: str, order: str = "height") -> Iterator[str]:
    """Rows that arrive part by part in the order of a column; a part has the files of all tasks and appears at once.

    All parts are written in one pass, so the work grows with the rows and not with rows times parts. Bounds are taken from
    the rows on as few columns as that takes; rows that are dear even so should be stored before.
    """
    spark = rows.sparkSession
    newest, count = rows.agg(F.max(order), F.count(F.lit(1))).first()
    step = newest // max(FEWEST_ARRIVALS, count // ARRIVAL_ROWS) + 1
    rows.withColumn(PART, F.expr(f"{order} div {step}")).write.partitionBy(PART).parquet(f"{folder}/all")
    fs = spark._jvm.org.apache.hadoop.fs
    arrived = fs.Path(f"{folder}/arrived")
    files = arrived.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(arrived)
    for i in range(newest // step + 1):
        part = fs.Path(f"{folder}/all/{PART}={i}")
        if files.exists(part):  # no row may fall into a part
            rename_once(spark, part, fs.Path(f"{folder}/arrived/{PART}={i}"))
            yield f"{folder}/arrived/*"


def follow_parts(rows: DataFrame, folder: str, order: str, run: Callable[[str], StreamingQuery]) -> StreamingQuery:
    """Run a query to its end after each arrival, going on from its checkpoint as after a restart."""
    query = None
    for path in arrivals(rows, folder, order):
        query = run(path)
        query.awaitTermination()
    return query


def follow_updates(inputs: Inputs, folder: str, advance) -> None:
    gate = CompletedBlocks(inputs.spark, f"{folder}/gate")

    def run(path: str) -> StreamingQuery:
        stream = inputs.spark.readStream.schema(UPDATE).parquet(path)
        return follow(stream, advance, gate, f"{folder}/checkpoint", available_now=True)

    # cut by event, so that a block can be split between two arrivals
    query = follow_parts(inputs.updates(), folder, "seq", run)
    finish(advance, gate, query.lastProgress["batchId"] + 1)


@register
def stream_tx_log(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    folder = new_folder(spark, "stream-log")

    def run(path: str) -> StreamingQuery:
        stream = events.valid_txs(open_stream(spark, path, module=None))
        return (
            stream.select("height", "txhash", F.size("events").alias("n_events"))
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{folder}/out")
        )

    follow_parts(inputs.log(), folder, "height", run)
    return spark.read.parquet(f"{folder}/out")


@register
def stream_reserves_diff(spark, sf_dir):
    folder = new_folder(spark, "stream-diff")
    derived = ReservesDiff(spark, folder)
    follow_updates(Inputs(spark, sf_dir), folder, derived.advance)
    return derived.read().select("seq", F.col("reserves").cast("long"), F.col("reserves_diff").cast("long"))


def _followed_book(spark, sf_dir) -> TickBook:
    folder = new_folder(spark, "stream-book")
    book = TickBook(spark, folder, compact_every=2)
    follow_updates(Inputs(spark, sf_dir), folder, book.advance)
    return book


@register
def stream_tick_book(spark, sf_dir):
    """Reserve and price rows of the followed book, in one result."""
    book = _followed_book(spark, sf_dir)
    reserves = book.read("reserves").select(
        F.lit("reserves").alias("kind"), "seq", "token0", "token1",
        F.col("reserves0").cast("long").alias("side0"), F.col("reserves1").cast("long").alias("side1"),
    )
    price = book.read("price").select(
        F.lit("price").alias("kind"), "seq", "token0", "token1",
        F.col("best0").cast("long").alias("side0"), F.col("best1").cast("long").alias("side1"),
    )
    return reserves.unionByName(price)


def _followed_log(spark, sf_dir) -> LogBook:
    inputs = Inputs(spark, sf_dir)
    folder = new_folder(spark, "stream-log-book")
    follower = LogBook(spark, folder, compact_every=2)

    def run(path: str) -> StreamingQuery:
        stream = open_stream(spark, path, module=None)
        return follow(stream, follower.advance, follower.gate, f"{folder}/checkpoint", available_now=True)

    # cut by transaction, so that a block can be split between two arrivals
    query = follow_parts(inputs.log(), folder, "position", run)
    finish(follower.advance, follower.gate, query.lastProgress["batchId"] + 1)
    return follower


@register
def stream_log_to_book(spark, sf_dir):
    """Reserve and price rows of a book that follows the records of the log."""
    book = _followed_log(spark, sf_dir).book
    sides = {"reserves": ("reserves0", "reserves1"), "price": ("best0", "best1")}
    parts = [
        book.read(kind).select(
            F.lit(kind).alias("kind"), "height", "token0", "token1",
            F.col(a).cast("long").alias("side0"), F.col(b).cast("long").alias("side1"),
        )
        for kind, (a, b) in sides.items()
    ]
    return parts[0].unionByName(parts[1])


@register
def stream_log_to_windows(spark, sf_dir):
    """Hourly locked value from the log: records to book to windows, each a stream."""
    follower = _followed_log(spark, sf_dir)
    folder = new_folder(spark, "stream-log-windows")
    query, output = windows.write_updates(
        windows.tvl_windows(follower.stream("reserves"), "1 hour"), f"{folder}/out", f"{folder}/checkpoint", available_now=True
    )
    windows.end(query)
    return windows.current_windows(output)


def _windowed(spark, rows: DataFrame, make, having_amount: bool = False) -> DataFrame:
    folder = new_folder(spark, "stream-windows")
    output = None
    for path in arrivals(stored(rows, "stream-rows"), folder):
        stream = make(spark.readStream.schema(rows.schema).parquet(path))
        query, output = windows.write_updates(stream, f"{folder}/out", f"{folder}/checkpoint", available_now=True)
        windows.end(query)
    return windows.current_windows(output, having_amount)


@register
def stream_windows(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return _windowed(spark, inputs.timed(inputs.reserves()), lambda s: windows.tvl_windows(s, "1 hour"))


@register
def stream_price_windows(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return _windowed(spark, inputs.timed(inputs.price()), lambda s: windows.ohlc_windows(s, "1 day"))


@register
def stream_volume_windows(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return _windowed(
        spark, inputs.swaps(), lambda s: windows.volume_windows(s, "1 day", 18000), having_amount=True
    )
