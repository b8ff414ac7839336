"""From the transaction log to typed events.

The events of a transaction sit in one record, so the message an event belongs to and its index are found inside the
record. Its place in the block needs the number of events of the transactions before it. A placed log
(``sources.placed``) keeps that number with each record, and decoding it is one scan without any exchange. Records of
another log are brought together by block once, as they are, and the log is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions import (
    amount,
    attributes_json,
    attributes_map,
    is_message_action,
    iso_to_unix,
    message_type_id,
    pack_seq,
)
from tidebook.functions.wide import beyond, wide_amount
from tidebook.schemas import DEX_ACTIONS, DEX_EVENT_TYPES, DEX_MODULE, PLACE


def valid_txs(log: DataFrame) -> DataFrame:
    """Keep successful transactions."""
    return log.where(F.col("code") == 0)


def is_placed(txs: DataFrame) -> bool:
    """Whether the records carry their place in the block."""
    return set(PLACE) <= set(txs.columns)


def tx_index_in_block(txs: DataFrame) -> DataFrame:
    """0-based place of each transaction among those of its block (failed ones are dropped before)."""
    if is_placed(txs):
        return txs
    in_block = W.partitionBy("height").orderBy("position")
    return txs.withColumn("tx_index", F.row_number().over(in_block) - 1)


def with_places(txs: DataFrame, *within: str) -> DataFrame:
    """Adds ``tx_index, events_before``: index in the block, and events of the transactions of the block before it.

    Null events count as none. A block is the largest group; records move whole and undecoded, at most once, and not at
    all where they are partitioned by ``within``, columns that follow from the height.
    """
    if is_placed(txs):
        return txs
    in_block = W.partitionBy(*within, "height").orderBy("position")
    before = in_block.rowsBetween(W.unboundedPreceding, -1)
    size = F.coalesce(F.size("events"), F.lit(0)).cast("long")
    return txs.withColumns(
        {
            "tx_index": F.row_number().over(in_block) - 1,
            "events_before": F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"),
        }
    )


def last_attribute(attributes: Column, key: str) -> Column:
    """Value of the last attribute with a key, null when there is none."""
    return F.get(
        F.reverse(F.filter(attributes, lambda a: F.coalesce(a["key"], F.lit("")) == key)), F.lit(0)
    )["value"]


def load_txs(log: DataFrame) -> DataFrame:
    """One row per successful transaction; its payload is never stored."""
    return tx_index_in_block(valid_txs(log)).select(
        "height",
        "tx_index",
        F.col("txhash").alias("hash"),
        "code",
        F.lit(None).cast("string").alias("data"),
        "info",
        "gas_wanted",
        "gas_used",
        "codespace",
    )


def _openings(events: Column) -> Column:
    """Where messages open: index of the event and action, after a first entry for what comes before any message."""
    marks = F.transform(
        events, lambda e, i: F.struct(i.alias("start"), last_attribute(e["attributes"], "action").alias("action"))
    )
    opened = F.filter(marks, lambda m: is_message_action(m["action"]))
    nobody = F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("action"))
    return F.concat(F.array(nobody), opened)


def _by_message(events: Column, starts: Column) -> Column:
    """The events of a transaction cut where messages open: index of the first event, action, and the events.

    The first part holds what comes before any message and may be empty. Every event is in one part, so the work grows
    with the events, not with events times messages. ``starts`` are the openings as a column of their own: an expression
    would be computed again for each part.
    """

    def part(mark: Column, k: Column) -> Column:
        end = F.when(k + 1 < F.size(starts), F.get(starts, k + 1)["start"]).otherwise(F.size(events))
        return F.struct(
            mark["start"].alias("start"), mark["action"].alias("action"),
            F.slice(events, mark["start"] + 1, end - mark["start"]).alias("events"),
        )

    return F.transform(starts, part)


def decode_events(txs: DataFrame) -> DataFrame:
    """One row per event with its attribute map and the message that was open before or at it."""
    timed = [c for c in ("time_unix",) if c in txs.columns]
    keys = ["height", *PLACE, *timed]
    placed = with_places(txs).where(F.size("events") > 0)
    opened = placed.select(*keys, "events", _openings(F.col("events")).alias("_starts"))
    parts = opened.select(*keys, F.explode(_by_message(F.col("events"), F.col("_starts"))).alias("part"))
    # maps are made in front of the generator: behind it, every filter on an attribute would make them again
    typed = F.transform(
        "part.events", lambda e: F.struct(e["type"].alias("type"), attributes_map(e["attributes"]).alias("attributes"))
    )
    exploded = parts.select(
        *keys,
        F.when(F.col("part.action").isNotNull(), F.struct("part.start", "part.action")).alias("_opened"),
        F.col("part.start").alias("_start"),
        F.posexplode(typed).alias("_place", "event"),
    )
    index = F.col("_start") + F.col("_place")
    return exploded.select(
        pack_seq(F.col("height"), F.col("events_before") + index).alias("seq"),
        "height",
        "tx_index",
        *timed,
        index.alias("event_index"),
        F.col("event.type").alias("type"),
        F.col("event.attributes").alias("attributes"),
        F.struct(F.col("_opened.start").alias("index"), F.col("_opened.action").alias("action")).alias("_message"),
    )


def assign_message(decoded: DataFrame) -> DataFrame:
    """Message of each event: the sequence number of the event that opened it, null before the first."""
    return decoded.withColumn("msg_seq", F.col("seq") - F.col("event_index") + F.col("_message.index"))


def message_type(messaged: DataFrame) -> DataFrame:
    """Enumeration id of each event's message; an unknown message has none."""
    return messaged.withColumn("msg_type", message_type_id(F.col("_message.action")))


def dex_filter() -> Column:
    attributes = F.col("attributes")
    action = F.coalesce(attributes["action"], F.lit(""))
    return (attributes["module"] == DEX_MODULE) & F.col("type").isin(*DEX_EVENT_TYPES) & (action != "")


def event_kind() -> Column:
    """The action of an exchange event that has a table of its own, ``other`` for any other event."""
    action = F.col("attributes")["action"]
    return F.when(F.coalesce(dex_filter(), F.lit(False)) & action.isin(*DEX_ACTIONS), action).otherwise(F.lit("other"))


def dex_events(decoded: DataFrame) -> DataFrame:
    """Events of the exchange that carry an action."""
    return decoded.where(dex_filter())


def load_events(txs: DataFrame) -> DataFrame:
    """All events of successful transactions with message and exchange columns."""
    return message_type(assign_message(decode_events(txs))).drop("_message")


def events_table(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Storage form: JSON attributes, message and one pair id per action."""
    return pair_action_flags(events, pairs).select(
        "seq",
        "height",
        "tx_index",
        "event_index",
        "type",
        attributes_json(F.col("attributes")).alias("attributes"),
        "msg_seq",
        "msg_type",
        "pair_swap",
        "pair_deposit",
        "pair_withdraw",
    )


def pair_action_flags(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pair id per action: the id when the event is that action of the exchange, else 0."""
    attributes = F.col("attributes")
    is_dex = F.coalesce(
        (attributes["module"] == DEX_MODULE) & F.col("type").isin(*DEX_EVENT_TYPES), F.lit(False)
    )
    ids = pairs.select(
        F.col("id").alias("_pair"),
        F.least("token0", "token1").alias("_low"),
        F.greatest("token0", "token1").alias("_high"),
    )
    # The pair is looked up in either token order. Most events ask for no pair: they take no part in the join.
    flagged_actions = F.coalesce(
        is_dex & attributes["action"].isin("PlaceLimitOrder", "DepositLP", "WithdrawLP"), F.lit(False)
    )
    token0, token1 = attributes["TokenZero"], attributes["TokenOne"]
    both = (F.coalesce(token0, F.lit("")) != "") & (F.coalesce(token1, F.lit("")) != "")
    asks = F.coalesce(flagged_actions & both, F.lit(False))
    keyed = events.where(asks).withColumn("_low", F.least(token0, token1)).withColumn("_high", F.greatest(token0, token1))
    joined = keyed.join(ids, ["_low", "_high"], "left")

    none = F.lit(0).cast("long")

    def flag(action: str) -> Column:
        return F.when(
            F.col("_pair").isNotNull() & (attributes["action"] == action), F.col("_pair")
        ).otherwise(F.lit(0).cast("long"))

    return (
        joined.withColumn("pair_swap", flag("PlaceLimitOrder"))
        .withColumn("pair_deposit", flag("DepositLP"))
        .withColumn("pair_withdraw", flag("WithdrawLP"))
        .drop("_pair", "_low", "_high")
        .unionByName(events.where(~asks).withColumns({f"pair_{a}": none for a in ("swap", "deposit", "withdraw")}))
    )


def route_by_action(dex: DataFrame) -> dict[str, DataFrame]:
    """The four typed inputs, as filters of one plan."""
    return {action: dex.where(F.col("attributes")["action"] == action) for action in DEX_ACTIONS}


def _keys(events: DataFrame) -> list[str]:
    known = ("seq", "height", "tx_index", "event_index", "time_unix", "msg_seq", "msg_type")
    return [c for c in known if c in events.columns]


def _whole(key: str) -> Column:
    return F.col("attributes")[key].try_cast("int")


def _text(key: str) -> Column:
    return F.col("attributes")[key]


def _amount(key: str) -> Column:
    return amount(F.col("attributes")[key])


def with_wide_texts(rows: DataFrame, events: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """Typed events with a column ``<amount>_wide`` for the text of amounts that have more than 38 digits.

    ``amounts`` names the attribute of each amount; only events with such a text are looked up.
    """
    texts = {name: beyond(_text(key)).alias(f"{name}_wide") for name, key in amounts.items()}
    found = events.where(dex_filter()).select("seq", *texts.values()).where(F.coalesce(*[f"{n}_wide" for n in texts]).isNotNull())
    return rows.join(found, "seq", "left")


def event_deposit(events: DataFrame) -> DataFrame:
    return events.where(dex_filter() & (_text("action") == "DepositLP")).select(
        *_keys(events),
        _text("Creator").alias("creator"),
        _text("Receiver").alias("receiver"),
        _text("TokenZero").alias("token0"),
        _text("TokenOne").alias("token1"),
        _whole("TickIndex").alias("tick"),
        _whole("Fee").alias("fee"),
        _amount("ReservesZeroDeposited").alias("deposited0"),
        _amount("ReservesOneDeposited").alias("deposited1"),
        _amount("SharesMinted").alias("shares"),
    )


def event_withdraw(events: DataFrame) -> DataFrame:
    return events.where(dex_filter() & (_text("action") == "WithdrawLP")).select(
        *_keys(events),
        _text("Creator").alias("creator"),
        _text("Receiver").alias("receiver"),
        _text("TokenZero").alias("token0"),
        _text("TokenOne").alias("token1"),
        _whole("TickIndex").alias("tick"),
        _whole("Fee").alias("fee"),
        _amount("ReservesZeroWithdrawn").alias("withdrawn0"),
        _amount("ReservesOneWithdrawn").alias("withdrawn1"),
        _amount("SharesRemoved").alias("shares_removed"),
    )


def event_place_order(events: DataFrame) -> DataFrame:
    """Limit orders; the token out is the pair's token that is not the token in."""
    token_out = F.when(_text("TokenIn") != _text("TokenZero"), _text("TokenZero")).otherwise(_text("TokenOne"))
    return events.where(dex_filter() & (_text("action") == "PlaceLimitOrder")).select(
        *_keys(events),
        _text("Creator").alias("creator"),
        _text("Receiver").alias("receiver"),
        _text("TokenZero").alias("token0"),
        _text("TokenOne").alias("token1"),
        _text("TokenIn").alias("token_in"),
        token_out.alias("token_out"),
        _amount("AmountIn").alias("amount_in"),
        _whole("LimitTick").alias("limit_tick"),
        _text("OrderType").alias("order_type"),
        _amount("Shares").alias("shares"),
        _text("TrancheKey").alias("tranche"),
    )


def _tick_updates(events: DataFrame) -> DataFrame:
    given = F.coalesce(F.nullif(_text("Reserves"), F.lit("")), F.lit("0"))
    fee = F.when(_whole("Fee") >= 0, _whole("Fee"))
    return events.where(dex_filter() & (_text("action") == "TickUpdate")).select(
        *_keys(events),
        _text("TokenZero").alias("token0"),
        _text("TokenOne").alias("token1"),
        _text("TokenIn").alias("token_in"),
        _whole("TickIndex").alias("tick"),
        fee.alias("fee"),
        given.alias("_reserves"),
    )


def parsed_tick_updates(events: DataFrame) -> DataFrame:
    """Tick updates with the text of their reserves, and these as decimal, else as limbs in ``_wide``, else neither."""
    read = _tick_updates(events).withColumn("reserves", amount(F.col("_reserves")))
    return read.withColumn("_wide", F.when(F.col("reserves").isNull(), wide_amount(F.col("_reserves"))))


def decimal_updates(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reserves").isNotNull()).drop("_reserves", "_wide")


def wide_updates(parsed: DataFrame) -> DataFrame:
    wide = parsed.where(F.col("reserves").isNull() & F.col("_wide").isNotNull())
    return wide.drop("_reserves", "reserves").withColumnRenamed("_wide", "reserves")


def rejected_updates(parsed: DataFrame) -> DataFrame:
    rejected = parsed.where(F.col("reserves").isNull() & F.col("_wide").isNull())
    return rejected.drop("reserves", "_wide").withColumnRenamed("_reserves", "reserves_text")


def event_tick_update(events: DataFrame) -> DataFrame:
    """Tick updates; the fee stays only when it is a number from 0 on, missing reserves count as 0."""
    return (
        _tick_updates(events)
        .withColumn("reserves", amount(F.col("_reserves")))
        .where(F.col("reserves").isNotNull())
        .drop("_reserves")
    )


def wide_tick_updates(events: DataFrame) -> DataFrame:
    """Tick updates whose reserves have more than 38 digits, as limbs."""
    return wide_updates(parsed_tick_updates(events))


def rejected_tick_updates(events: DataFrame) -> DataFrame:
    """Tick updates whose reserves are no integer, with the original text."""
    return rejected_updates(parsed_tick_updates(events))


def load_blocks(txs: DataFrame) -> DataFrame:
    """One row per height; the first transaction of a block gives its time.

    The first position is found on numbers alone; its text is joined to the one row per block.
    """
    narrow = txs.select("height", "position", "timestamp")
    first = narrow.groupBy("height").agg(F.min("position").alias("position"))
    return (
        narrow.join(first, ["height", "position"])
        .select("height", F.col("timestamp").alias("time"))
        .withColumn("time_unix", iso_to_unix("time"))
    )
