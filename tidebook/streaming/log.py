"""From the stream of transaction records to the tick book and on to windows, without a batch run in between.

A micro-batch is a static table, so decoding is the batch decoding of the complete blocks in it. Places of events depend
on the events of their block alone; a block is decoded once it is complete, so they are those of a full run.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import dimensions, events
from tidebook.operators.ordered import DEFAULT_SPAN
from tidebook.schemas import SWAP_MESSAGE, TX_LOG
from tidebook.session import cut
from tidebook.streaming.follow import CompletedBlocks, TickBook
from tidebook.streaming.state_table import BatchOutput

RECORD = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TX_LOG)


class LogBook:
    """Follows records of the log: ``advance`` is given to ``follow`` and ``finish`` together with ``gate``.

    Besides the outputs of the book, reserve totals, prices and swaps are kept with their block time, as the tables that
    streaming windows read.
    """

    def __init__(self, spark: SparkSession, folder: str, span: int = DEFAULT_SPAN, compact_every: int = 20):
        self.spark = spark
        self.gate = CompletedBlocks(spark, f"{folder}/gate", RECORD)
        self.book = TickBook(spark, f"{folder}/book", span, compact_every)
        kept = {
            "reserves": TickBook.OUTPUTS["reserves"],
            "price": TickBook.OUTPUTS["price"],
            "swaps": f"{TickBook.OUTPUTS['tick_update']}, msg_type int",
        }
        self.timed = {n: BatchOutput(spark, f"{folder}/timed/{n}", f"{s}, time_unix long") for n, s in kept.items()}

    def advance(self, records: DataFrame, batch: int) -> None:
        """Decode the complete blocks of a batch and derive everything from their tick updates."""
        txs = events.valid_txs(records)
        updates = cut(events.event_tick_update(events.load_events(txs)))
        self.book.advance(updates.drop("tx_index", "event_index", "msg_seq"), batch)
        block = cut(events.load_blocks(txs))

        def add_times(name: str, output: BatchOutput) -> None:
            source = self.book.outputs["tick_update" if name == "swaps" else name]
            schema = output.schema.rsplit(",", 1)[0]
            rows = self.spark.read.schema(schema).parquet(f"{source.folder}/batch={batch}")
            if name == "swaps":
                rows = rows.where(F.col("msg_type") == SWAP_MESSAGE)
            columns = [c.split()[0] for c in output.schema.split(", ")]
            output.write(batch, dimensions.join_event_time(rows, block).select(*columns))

        with ThreadPoolExecutor(len(self.timed)) as pool:
            for step in [pool.submit(add_times, *timed) for timed in self.timed.items()]:
                step.result()

    def stream(self, name: str) -> DataFrame:
        """Timed rows as a stream: ``reserves``, ``price`` or ``swaps``.

        A trigger takes all whole batches that are there. Files of a batch are not in the order of time, so a limit on files
        would tear batches apart and let the watermark pass rows that have not been read.
        """
        output = self.timed[name]
        return self.spark.readStream.schema(f"{output.schema}, batch long").parquet(output.folder).drop("batch")
