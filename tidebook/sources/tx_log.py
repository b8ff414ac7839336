"""The ordered transaction log, from JSON or Parquet files, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.schemas import DEX_MODULE, TX_LOG


def has_module(module: str = DEX_MODULE) -> Column:
    """Whether a transaction holds a message event of a module."""
    return F.exists(
        "events",
        lambda e: (e["type"] == "message")
        & F.exists(e["attributes"], lambda a: (a["key"] == "module") & (a["value"] == module)),
    )


def read_tx_log(
    spark: SparkSession, path: str, from_height: int = 0, module: str | None = DEX_MODULE, format: str = "parquet"
) -> DataFrame:
    """Scan the log from a height on, keeping transactions with a message of the module."""
    log = spark.read.schema(TX_LOG).format(format).load(path).where(F.col("height") >= from_height)
    return log.where(has_module(module)) if module else log


def stream_tx_log(
    spark: SparkSession,
    path: str,
    from_height: int = 0,
    module: str | None = DEX_MODULE,
    format: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Follow the log; new files are picked up by each trigger."""
    reader = spark.readStream.schema(TX_LOG).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    log = reader.load(path).where(F.col("height") >= from_height)
    return log.where(has_module(module)) if module else log


def normalise_tx(raw: DataFrame) -> DataFrame:
    """Raw search result to the flat transaction record (without the block time)."""
    result = F.col("tx_result")
    return raw.select(
        "position",
        F.col("height").cast("long").alias("height"),
        F.col("hash").alias("txhash"),
        result["code"].alias("code"),
        result["info"].alias("info"),
        result["codespace"].alias("codespace"),
        result["gas_wanted"].alias("gas_wanted"),
        result["gas_used"].alias("gas_used"),
        result["events"].alias("events"),
    )


def read_headers_join(txs: DataFrame, headers: DataFrame) -> DataFrame:
    """Fill the block time into each transaction. Spark broadcasts the headers only while they are small."""
    times = headers.select("height", F.col("time").alias("timestamp"))
    return txs.drop("timestamp").join(times, "height", "left")
