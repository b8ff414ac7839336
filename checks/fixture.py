"""Inputs of the operators, derived from the driver's tables.

``market_events`` is the flat form. ``tx_log`` nests the same events into transaction records; there each event
becomes up to three raw events: the marker that opens a message, the typed event, and the tick update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.session import configure, tasks_for

AMOUNT = "decimal(38,0)"
#: Flat events of a task that builds transaction records.
EVENTS_PER_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def token(number: Column) -> Column:
    """Token name of a number, with at least two digits."""
    return F.concat(F.lit("T"), F.when(number < 10, F.lit("0")).otherwise(F.lit("")), number.cast("string"))


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in flat form, failed transactions included."""
    source = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    pair = F.col("user_id") % 10
    place = F.col("event_id") % 12
    height = F.expr("event_id div 12") + 1
    user = F.col("user_id") % 3
    return source.select(
        F.col("event_id").alias("seq"),
        height.alias("height"),
        F.expr("(event_id % 12) div 4").cast("int").alias("tx_index"),
        (F.col("event_id") % 4).cast("int").alias("event_index"),
        "user_id",
        kind.alias("event_type"),
        token(pair).alias("token0"),
        token(pair + 1).alias("token1"),
        (F.expr("user_id div 10") % 2).cast("int").alias("side"),
        (F.regexp_extract("props", r"([0-9]+)", 1).cast("int") % 12 - 6).alias("tick"),
        F.when(user == 0, 1).when(user == 1, 5).otherwise(20).alias("fee"),
        F.round(F.col("value") * 100).cast("long").alias("amount"),
        F.when(kind.isin("error", "view", "signup"), F.lit(0).cast("long"))
        .otherwise(F.round(F.col("value") * 100).cast("long"))
        .alias("reserves"),
        F.when(kind == "purchase", 3).when(kind == "signup", 1).when(kind == "click", 0).alias("marker"),
        F.when((height % 10 == 0) & (place >= 8), 5).otherwise(0).alias("code"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("micros"),
    )


def _time_text() -> Column:
    return F.concat(F.date_format(F.timestamp_micros("micros"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block headers; a block's time is that of its first event."""
    first = market_events(spark, sf_dir).groupBy("height").agg(F.min("micros").alias("micros"))
    return first.select("height", _time_text().alias("time"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = market_events(spark, sf_dir).groupBy("height").agg(F.min("micros").alias("micros"))
    return first.select("height", F.round(F.col("micros") / 1000000).cast("long").alias("time_unix"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick updates of successful transactions."""
    return (
        market_events(spark, sf_dir)
        .where(F.col("code") == 0)
        .select(
            "seq",
            "height",
            "token0",
            "token1",
            F.when(F.col("side") == 0, F.col("token0")).otherwise(F.col("token1")).alias("token_in"),
            "tick",
            "fee",
            F.col("reserves").cast(AMOUNT).alias("reserves"),
        )
    )


def updates_with_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick updates with the type of the message open at each of them; a transaction holds at most four."""
    upto = W.partitionBy("height", "tx_index").orderBy("event_index").rowsBetween(W.unboundedPreceding, 0)
    events = market_events(spark, sf_dir).where(F.col("code") == 0)
    messaged = events.withColumn("msg_type", F.last("marker", ignorenulls=True).over(upto))
    return messaged.select(
        "seq",
        "height",
        "token0",
        "token1",
        F.when(F.col("side") == 0, F.col("token0")).otherwise(F.col("token1")).alias("token_in"),
        "tick",
        "fee",
        F.col("reserves").cast(AMOUNT).alias("reserves"),
        "msg_type",
    )


# --- nested form -----------------------------------------------------------------------------------------------


def _attributes(pairs: dict[str, Column | str]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("key"),
                (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value"),
            )
            for k, v in pairs.items()
        ]
    )


def _event(kind: str, *attributes: Column) -> Column:
    joined = attributes[0] if len(attributes) == 1 else F.concat(*attributes)
    return F.struct(F.lit(kind).alias("type"), joined.alias("attributes"))


def _raw() -> Column:
    """The raw events of one flat event."""
    e = {c: F.col(c) for c in ("event_type", "side", "token0", "token1", "user_id", "amount", "marker", "tick", "fee", "seq", "reserves")}
    kind = e["event_type"]
    token_in = F.when(e["side"] == 0, e["token0"]).otherwise(e["token1"])
    user = F.concat(F.lit("u"), e["user_id"].cast("string"))
    pair = {"TokenZero": e["token0"], "TokenOne": e["token1"]}
    amount = e["amount"]
    marker = F.when(
        e["marker"] == 3, _event("message", _attributes({"action": "/neutron.dex.MsgPlaceLimitOrder"}))
    ).when(e["marker"] == 1, _event("message", _attributes({"action": "/neutron.dex.MsgDeposit"}))).when(
        e["marker"] == 0, _event("message", _attributes({"action": "/other.bank.MsgSend"}))
    )
    owner = {"Creator": user, "Receiver": user}
    deposit = _attributes(
        {"module": "dex", "action": "DepositLP", **owner, **pair, "TickIndex": e["tick"], "Fee": e["fee"],
         "ReservesZeroDeposited": amount, "ReservesOneDeposited": amount + 1, "SharesMinted": amount * 2}
    )
    withdraw = _attributes(
        {"module": "dex", "action": "WithdrawLP", **owner, **pair, "TickIndex": e["tick"], "Fee": e["fee"],
         "ReservesZeroWithdrawn": amount, "ReservesOneWithdrawn": amount + 1, "SharesRemoved": amount * 2}
    )
    order = _attributes(
        {"module": "dex", "action": "PlaceLimitOrder", **owner, **pair, "TokenIn": token_in, "AmountIn": amount,
         "LimitTick": e["tick"], "OrderType": "GOOD_TIL_CANCELLED", "Shares": amount,
         "TrancheKey": F.concat(F.lit("k"), e["seq"].cast("string"))}
    )
    typed = F.when(kind == "signup", _event("message", deposit)).when(
        kind == "view", _event("message", withdraw)
    ).when(kind == "purchase", _event("message", order))
    # a repeated key and a missing value, which decoding has to settle
    update = _event(
        "TickUpdate",
        _attributes({"action": "stale", "note": F.lit(None)}),
        _attributes(
            {"module": "dex", "action": "TickUpdate", **pair, "TokenIn": token_in, "TickIndex": e["tick"],
             "Fee": e["fee"], "Reserves": e["reserves"]}
        ),
    )
    return F.filter(F.array(marker, typed, update), lambda e: e.isNotNull())


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction records with the time of their block.

    Flat columns are shuffled; raw events, many times as large, are made behind that and grouped where they are. Tasks have a
    bounded number of rows: sizes of shuffled rows say little here, as they compress well.
    """
    tasks = tasks_for(spark, table(spark, sf_dir, "events").count(), EVENTS_PER_TASK)
    rows = market_events(spark, sf_dir).repartition(tasks, "height")
    timed = rows.withColumn("micros", F.min("micros").over(W.partitionBy("height")))
    # a transaction holds four flat events by construction
    in_order = F.array_sort(F.collect_list(F.struct("event_index", "raw")))
    grouped = timed.withColumn("raw", _raw()).groupBy("height", "tx_index").agg(
        F.max("code").alias("code"), F.min("micros").alias("micros"), in_order.alias("parts")
    )
    hashed = F.md5(F.concat_ws("-", F.col("height").cast("string"), F.col("tx_index").cast("string")))
    return grouped.select(
        ((F.col("height") - 1) * 3 + F.col("tx_index")).alias("position"),
        "height",
        hashed.alias("txhash"),
        _time_text().alias("timestamp"),
        "code",
        F.lit("").alias("info"),
        F.when(F.col("code") == 0, F.lit("")).otherwise(F.lit("dex")).alias("codespace"),
        F.lit("200000").alias("gas_wanted"),
        (F.col("height") * 10 + F.col("tx_index")).cast("string").alias("gas_used"),
        F.flatten(F.transform("parts", lambda p: p["raw"])).alias("events"),
    )


def tx_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction records with their block time."""
    return _nested(spark, sf_dir)


def raw_search_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as the chain's search delivers them."""
    return _nested(spark, sf_dir).select(
        "position",
        F.col("txhash").alias("hash"),
        F.col("height").cast("string").alias("height"),
        F.struct("code", "info", "codespace", "gas_wanted", "gas_used", "events").alias("tx_result"),
    )


# --- token metadata ------------------------------------------------------------------------------------------------


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token metadata from ``part``: one asset per part key, shown in a unit of a larger exponent."""
    name = token(F.col("p_partkey"))
    shown = F.concat(F.lit("D"), name)
    unit = "struct<denom:string,exponent:int,aliases:array<string>>"
    channel = F.concat(F.lit("channel-"), F.col("p_size").cast("string"))
    base = F.struct(name.alias("denom"), F.lit(0).alias("exponent"), F.array().cast("array<string>").alias("aliases"))
    display = F.struct(
        F.concat(F.lit("X"), name).alias("denom"), (F.col("p_size") % 7).cast("int").alias("exponent"),
        F.array(shown).alias("aliases"),
    )
    trace = F.struct(
        F.when(F.col("p_partkey") % 5 == 4, F.lit("other")).otherwise(F.lit("ibc")).alias("type"),
        F.struct(F.lit("transfer").alias("port"), channel.alias("channel_id")).alias("chain"),
        F.struct(
            F.concat(F.lit("chain"), (F.col("p_size") % 4).cast("string")).alias("chain_name"),
            name.alias("base_denom"),
        ).alias("counterparty"),
    )
    return table(spark, sf_dir, "part").select(
        name.alias("base"),
        shown.alias("display"),
        F.concat(F.lit("coin-"), F.col("p_partkey").cast("string")).alias("price_id"),
        F.array(base.cast(unit), display.cast(unit)).alias("denom_units"),
        channel.alias("dst_channel"),
        F.array(trace).alias("traces"),
        "p_partkey",
    )


def price_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two refreshes of the prices; the second one misses every fifth price, and some tokens never have one."""
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") % 4 != 3)
    price_id = F.concat(F.lit("coin-"), F.col("p_partkey").cast("string"))
    usd = F.col("p_retailprice") / 1000
    first = part.select(
        price_id.alias("price_id"),
        F.when(F.col("p_partkey") % 5 == 0, usd).otherwise(usd / 2).alias("usd"),
        F.lit(100).cast("long").alias("last_updated_at"),
    )
    second = part.select(
        price_id.alias("price_id"),
        F.when(F.col("p_partkey") % 5 != 0, usd).alias("usd"),
        F.lit(200).cast("long").alias("last_updated_at"),
    )
    return first.unionByName(second)
