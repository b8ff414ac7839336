"""The transaction log laid out by block, each record with its place, so that decoding it is a scan without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidebook.operators.events import valid_txs, with_places
from tidebook.schemas import PLACE, TX_LOG
from tidebook.session import tasks_for
from tidebook.sources.tables import RANGE, RANGE_SPAN, RUN, read_table, spread_by_runs, without_folders

#: Records that a task sorts, on average.
RECORDS_PER_TASK = 25_000
PLACED_LOG = T.StructType(
    [*TX_LOG.fields, T.StructField(PLACE[0], T.IntegerType()), T.StructField(PLACE[1], T.LongType())]
)


def store_placed(log: DataFrame, path: str, blocks: int = RANGE_SPAN) -> None:
    """Write the successful transactions of whole blocks in folders of ``blocks`` blocks, with ``tx_index, events_before``.

    Places are counted among the records given, so a filter by module comes before. Records move once, undecoded, by run
    of blocks: the window that numbers them and the files share that partitioning and its order. Every later decoding
    moves none. Records are counted before, on as few columns as that takes, so that the rows a task sorts stay bounded.
    Null events count as none; an empty log gives an empty table.
    """
    txs = valid_txs(log)
    spread = spread_by_runs(txs, blocks, tasks=tasks_for(log.sparkSession, txs.count(), RECORDS_PER_TASK))
    placed = with_places(spread, RANGE, RUN).select(*[f.name for f in PLACED_LOG], RANGE)
    placed.write.mode("overwrite").partitionBy(RANGE).parquet(path)


def read_placed(
    spark: SparkSession, path: str, from_height: int = 0, to_height: int | None = None, blocks: int = RANGE_SPAN
) -> DataFrame:
    """A placed log, for ``events.load_events``, ``load_txs``, ``load_blocks`` and the warehouse.

    As for every stored table, only heights above ``from_height`` and up to ``to_height`` are read, by folder and row group.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PLACED_LOG)
    return without_folders(read_table(spark, path, schema, from_height, to_height, blocks))
