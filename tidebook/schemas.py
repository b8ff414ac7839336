"""Schemas, enumerations and limits of the event warehouse."""

from __future__ import annotations

from pyspark.sql import types as T

ATTRIBUTE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
EVENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("attributes", T.ArrayType(ATTRIBUTE))])

# One record of the transaction log. ``position`` is the record's place in the ordered log.
TX_LOG = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("txhash", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("info", T.StringType()),
        T.StructField("codespace", T.StringType()),
        T.StructField("gas_wanted", T.StringType()),
        T.StructField("gas_used", T.StringType()),
        T.StructField("events", T.ArrayType(EVENT)),
    ]
)

# Place of a record in its block: index among the successful transactions, events of those before it.
PLACE = ("tx_index", "events_before")

# The search result as the chain delivers it: the transaction result is nested and heights are text.
RAW_SEARCH_RESULT = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("height", T.StringType()),
        T.StructField(
            "tx_result",
            T.StructType(
                [
                    T.StructField("code", T.IntegerType()),
                    T.StructField("info", T.StringType()),
                    T.StructField("codespace", T.StringType()),
                    T.StructField("gas_wanted", T.StringType()),
                    T.StructField("gas_used", T.StringType()),
                    T.StructField("events", T.ArrayType(EVENT)),
                ]
            ),
        ),
    ]
)

HEADERS = T.StructType([T.StructField("height", T.LongType()), T.StructField("time", T.StringType())])

DENOM_UNIT = T.StructType(
    [
        T.StructField("denom", T.StringType()),
        T.StructField("exponent", T.IntegerType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
    ]
)
TRACE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "chain",
            T.StructType([T.StructField("port", T.StringType()), T.StructField("channel_id", T.StringType())]),
        ),
        T.StructField(
            "counterparty",
            T.StructType([T.StructField("chain_name", T.StringType()), T.StructField("base_denom", T.StringType())]),
        ),
    ]
)
ASSETS = T.StructType(
    [
        T.StructField("base", T.StringType()),
        T.StructField("display", T.StringType()),
        T.StructField("price_id", T.StringType()),
        T.StructField("denom_units", T.ArrayType(DENOM_UNIT)),
        T.StructField("traces", T.ArrayType(TRACE)),
    ]
)
PRICES = T.StructType(
    [
        T.StructField("price_id", T.StringType()),
        T.StructField("usd", T.DoubleType()),
        T.StructField("last_updated_at", T.LongType()),
    ]
)

AMOUNT = T.DecimalType(38, 0)

# Message enumeration.
MESSAGE_TYPES = {
    "neutron.dex.MsgDeposit": 1,
    "neutron.dex.MsgWithdrawal": 2,
    "neutron.dex.MsgPlaceLimitOrder": 3,
}
SWAP_MESSAGE = 3

# Event module, event types and actions of the exchange.
DEX_MODULE = "dex"
DEX_EVENT_TYPES = ("message", "TickUpdate")
DEX_ACTIONS = ("DepositLP", "WithdrawLP", "PlaceLimitOrder", "TickUpdate")

# A packed sequence number is the height, then 32 bits for the place of the event among all events of its block.
PLACE_BITS = 32

# Columns of the stored warehouse tables. An amount of more than 38 digits is null, its text is in ``<amount>_wide``.
_PLACE = "seq long, height long, tx_index int, event_index int, time_unix long, msg_seq long, msg_type int"
_PAIR = "token0 string, token1 string"
_LIQUIDITY = f"{_PLACE}, creator string, receiver string, {_PAIR}, tick int, fee int"
TABLES = {
    "block": "height long, time string, time_unix long",
    "tx": "height long, tx_index int, hash string, code int, data string, info string, gas_wanted string, "
    "gas_used string, codespace string",
    "tx_msg_type": "id int, action string",
    "tx_msg": "seq long, height long, type int",
    "events": "seq long, height long, tx_index int, time_unix long, event_index int, type string, "
    "attributes map<string,string>, msg_seq long, msg_type int, pair_swap long, pair_deposit long, pair_withdraw long",
    "tokens": "id long, token string, first_seq long",
    "pairs": f"id long, {_PAIR}, first_seq long",
    "deposit": f"{_LIQUIDITY}, deposited0 decimal(38,0), deposited1 decimal(38,0), shares decimal(38,0), "
    "deposited0_wide string, deposited1_wide string, shares_wide string",
    "withdraw": f"{_LIQUIDITY}, withdrawn0 decimal(38,0), withdrawn1 decimal(38,0), shares_removed decimal(38,0), "
    "withdrawn0_wide string, withdrawn1_wide string, shares_removed_wide string",
    "place_order": f"{_PLACE}, creator string, receiver string, {_PAIR}, token_in string, token_out string, "
    "amount_in decimal(38,0), limit_tick int, order_type string, shares decimal(38,0), tranche string, "
    "amount_in_wide string, shares_wide string",
    "tick_update": f"{_PLACE}, {_PAIR}, token_in string, tick int, fee int, reserves decimal(38,0), "
    "reserves_diff decimal(38,0), reserves_wide string, reserves_diff_wide string",
    "rejected": f"{_PLACE}, {_PAIR}, token_in string, tick int, fee int, reserves_text string",
    "tick_state": f"{_PAIR}, token string, tick int, fee int, reserves decimal(38,0), height long, seq long, "
    "reserves_wide string",
    "tick_snapshot": f"{_PAIR}, token string, tick int, fee int, reserves decimal(38,0), height long, seq long, "
    "reserves_wide string",
    "reserves_snapshot": f"height long, seq long, {_PAIR}, reserves0 double, reserves1 double, time_unix long",
    "price": f"height long, seq long, {_PAIR}, best0 int, best1 int, last int, time_unix long",
    "reserves": f"height long, seq long, {_PAIR}, reserves0 double, reserves1 double, time_unix long",
}

# What later blocks have to know of a stored warehouse: one row per key, whatever the length of the history.
_TICK = f"{_PAIR}, token_in string, tick int"
CARRIED = {
    "carried_marks": f"{_TICK}, reserves decimal(38,0), seq long, reserves_wide string",
    "carried_ticks": f"{_TICK}, fee int, reserves decimal(38,0), height long, seq long, reserves_wide string",
    "carried_totals": f"{_PAIR}, reserves0 decimal(38,0), reserves1 decimal(38,0), seen0 long, seen1 long, "
    "reserves0_wide string, reserves1_wide string",
    "carried_best": f"{_PAIR}, best0 int, best1 int, seq long",
    "carried_reserves": TABLES["reserves"],
}
