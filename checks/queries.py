"""One registered query per operator, over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixture as fx
from tidebook import functions as fn
from tidebook.operators import assets, changes, dimensions, events, liquidity, paging, ranges, series, state
from tidebook.plans import queries as plans
from tidebook.plans import warehouse
from tidebook.session import new_folder, stored
from tidebook.sources import placed, reference_data, tables, tx_log

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
DAY = 86400


def register(run: Query) -> Query:
    REGISTERED[run.__name__] = run
    return run


class Inputs:
    """Inputs and parameters of the queries for one session and folder.

    Blocks and decoded events are stored once per query, as in a warehouse, because several parts of a plan read them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def _block(self) -> DataFrame:
        return stored(fx.blocks(self.spark, self.dir), "block")

    def block(self) -> DataFrame:
        return self._block

    @cached_property
    def _newest(self):
        return ranges.last_block(self.block()).first()

    @property
    def max_height(self) -> int:
        return self._newest["height"]

    @property
    def last(self) -> int:
        return self.max_height - 1

    @property
    def half(self) -> int:
        return self.max_height // 2

    @property
    def now(self) -> int:
        return self._newest["time_unix"] // 60 * 60

    def updates(self) -> DataFrame:
        return fx.updates(self.spark, self.dir)

    def changes(self) -> DataFrame:
        return state.state_changes(self.updates())

    def versions(self) -> DataFrame:
        return state.versions_of_changes(self.changes())

    def reserves(self) -> DataFrame:
        return state.reserves_series(self.updates())

    def price(self) -> DataFrame:
        return state.best_price_of_changes(self.changes())

    def timed(self, rows: DataFrame) -> DataFrame:
        return dimensions.join_event_time(rows, self.block())

    def swaps(self) -> DataFrame:
        diffs = state.reserves_diff(fx.updates_with_message(self.spark, self.dir))
        return dimensions.join_event_msg_time(diffs, self.block())

    def log(self) -> DataFrame:
        return fx.tx_log(self.spark, self.dir)

    def txs(self) -> DataFrame:
        return events.tx_index_in_block(events.valid_txs(self.log()))

    def loaded(self) -> DataFrame:
        return events.load_events(self.txs())

    @cached_property
    def stored_events(self) -> DataFrame:
        return stored(self.loaded(), "events")

    def tokens(self) -> DataFrame:
        return dimensions.first_seen_tokens(self.stored_events)

    def pairs(self) -> DataFrame:
        return dimensions.first_seen_pairs(self.stored_events)

    def unit_prices(self) -> DataFrame:
        listed = fx.assets(self.spark, self.dir).withColumn("token", F.col("base"))
        return assets.unit_prices(listed, reference_data.read_token_prices(fx.price_versions(self.spark, self.dir)))

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.dir, name)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- sources, sinks and loading --------------------------------------------------------------------------------------


@register
def read_tx_log(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    folder = new_folder(spark, "log")
    inputs.log().write.parquet(folder)
    found = tx_log.read_tx_log(spark, folder, inputs.half)
    return found.select("height", "txhash", "code", F.size("events").alias("n_events"))


@register
def read_headers_join(spark, sf_dir):
    txs = tx_log.normalise_tx(fx.raw_search_result(spark, sf_dir))
    return tx_log.read_headers_join(txs, fx.headers(spark, sf_dir)).select("height", "txhash", "timestamp")


@register
def normalise_tx(spark, sf_dir):
    txs = tx_log.normalise_tx(fx.raw_search_result(spark, sf_dir))
    return txs.withColumn("n_events", F.size("events")).drop("events")


@register
def load_blocks(spark, sf_dir):
    return events.load_blocks(events.valid_txs(fx.tx_log(spark, sf_dir)))


@register
def load_txs(spark, sf_dir):
    return events.load_txs(fx.tx_log(spark, sf_dir))


@register
def load_events(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return events.events_table(inputs.stored_events, inputs.pairs())


@register
def load_dimensions(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    tokens = inputs.tokens().select(
        F.lit("token").alias("kind"), "id", F.col("token").alias("name"), F.lit("").alias("second"), "first_seq"
    )
    pairs = inputs.pairs().select(
        F.lit("pair").alias("kind"), "id", F.col("token0").alias("name"), F.col("token1").alias("second"), "first_seq"
    )
    return tokens.unionByName(pairs)


@register
def upsert_latest(spark, sf_dir):
    rows = Inputs(spark, sf_dir).changes().select(*state.STATE, "height", "seq", "reserves")
    latest = state.upsert_latest(rows, [*state.STATE, "height"], "seq")
    return latest.withColumn("reserves", F.col("reserves").cast("long"))


@register
def read_token_prices(spark, sf_dir):
    return reference_data.read_token_prices(fx.price_versions(spark, sf_dir)).select(
        "price_id", F.round("usd", 9).alias("usd"), "last_updated_at"
    )


@register
def read_assets(spark, sf_dir):
    static = fx.assets(spark, sf_dir)
    dynamic = static.where(F.col("p_partkey") % 3 != 0).withColumn("price_id", F.concat("price_id", F.lit("-new")))
    return reference_data.read_assets(dynamic, static).select(
        "base", "display", "price_id", fn.denom_exponent(F.col("denom_units"), F.col("display")).alias("exponent")
    )


@register
def browse_tables(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    found = tables.browse_tables(
        {
            "block": inputs.block().select(F.col("height").alias("key")),
            "orders": inputs.table("orders").select(F.col("o_orderkey").alias("key")),
            "tick_update": inputs.updates().select(F.col("seq").alias("key")),
        },
        {"block": "key", "orders": "key", "tick_update": "key"},
    )
    return union([df.withColumn("table_name", F.lit(name)) for name, df in found.items()])


@register
def to_response_rows(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    daily = series.ohlc(inputs.timed(inputs.price()), "day")
    return tables.to_response_rows(daily, "time_unix", ["open", "high", "low", "close"])


# --- projections, filters, predicates ------------------------------------------------------------------------------


@register
def valid_txs(spark, sf_dir):
    return events.valid_txs(fx.tx_log(spark, sf_dir)).select("height", "position", "txhash", "code")


@register
def decode_events(spark, sf_dir):
    attributes = F.col("attributes")
    return events.decode_events(Inputs(spark, sf_dir).txs()).select(
        "seq",
        "event_index",
        "type",
        attributes["action"].alias("action"),
        attributes["note"].alias("note"),
        F.size("attributes").alias("n_attributes"),
    )


@register
def decode_placed_log(spark, sf_dir):
    """The log laid out by block and read back above the half of its heights, decoded without a shuffle."""
    inputs = Inputs(spark, sf_dir)
    folder = new_folder(spark, "placed")
    placed.store_placed(inputs.log(), folder, blocks=1000)
    found = events.load_events(placed.read_placed(spark, folder, inputs.half, blocks=1000))
    return found.select("seq", "height", "tx_index", "event_index", "type", "msg_seq", "msg_type")


@register
def dex_events(spark, sf_dir):
    found = events.dex_events(Inputs(spark, sf_dir).loaded())
    return found.select("seq", "type", F.col("attributes")["action"].alias("action"))


@register
def route_by_action(spark, sf_dir):
    routed = events.route_by_action(events.dex_events(Inputs(spark, sf_dir).stored_events))
    return union([df.select(F.lit(action).alias("action"), "seq") for action, df in routed.items()])


def _with_long_amounts(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast("long") if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema]
    )


@register
def event_deposit(spark, sf_dir):
    return _with_long_amounts(events.event_deposit(Inputs(spark, sf_dir).loaded())).drop("msg_seq", "msg_type")


@register
def event_withdraw(spark, sf_dir):
    return _with_long_amounts(events.event_withdraw(Inputs(spark, sf_dir).loaded())).drop("msg_seq", "msg_type")


@register
def event_place_order(spark, sf_dir):
    return _with_long_amounts(events.event_place_order(Inputs(spark, sf_dir).loaded())).drop("msg_seq", "msg_type")


@register
def event_tick_update(spark, sf_dir):
    return _with_long_amounts(events.event_tick_update(Inputs(spark, sf_dir).loaded()))


@register
def pair_action_flags(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return events.pair_action_flags(inputs.stored_events, inputs.pairs()).select(
        "seq", "pair_swap", "pair_deposit", "pair_withdraw"
    )


@register
def block_range(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return ranges.block_range(inputs.updates(), inputs.half, 0, inputs.last).select("seq", "height")


@register
def time_range(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    rows = ranges.time_range(
        inputs.updates(), inputs.block(), inputs.last, after=inputs.now - 7 * DAY, before=inputs.now - DAY
    )
    return rows.select("seq", "height")


@register
def aligned_time_bounds(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    rows = []
    for resolution in fn.RESOLUTIONS:
        low, high = ranges.aligned_time_bounds(inputs.block(), inputs.half, inputs.last, resolution)
        rows.append(low.select(F.lit(resolution).alias("resolution"), "low", high.scalar().alias("high")))
    return union(rows)


def _state_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("reserves", F.col("reserves").cast("long")).select(
        "token0", "token1", "token", "tick", "fee", "reserves", "height"
    )


@register
def live_ticks(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return _state_rows(state.live_ticks(state.latest_tick_state(inputs.versions(), 0, inputs.last)))


@register
def priced_only(spark, sf_dir):
    return series.priced_only(Inputs(spark, sf_dir).price()).select("seq", "token0", "token1", "last")


def _daily(inputs: Inputs) -> DataFrame:
    return plans.price_series(inputs.timed(inputs.price()), inputs.block(), "day", 0, inputs.last)


@register
def orient_pair(spark, sf_dir):
    return liquidity.orient_pair(_daily(Inputs(spark, sf_dir)), True, "price")


@register
def orient_pair_amounts(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    daily = plans.volume_series(inputs.swaps(), inputs.block(), "day", 0, inputs.last)
    return liquidity.orient_pair(daily, F.col("token0") < "T05", "amounts")


@register
def orient_pair_liquidity(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.orient_pair(liquidity.pair_liquidity(inputs.versions(), 0, inputs.last), True, "liquidity")


def _mapping(inputs: Inputs) -> DataFrame:
    number = F.col("p_partkey")
    return inputs.table("part").where(number % 2 == 0).select(
        fx.token(number).alias("denom"), fx.token(number + 1).alias("real_denom")
    )


@register
def remap_tokens(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    rows = inputs.updates().select("seq", F.col("token_in").alias("token"))
    return assets.remap_tokens(rows, _mapping(inputs))


# --- joins and lookups -----------------------------------------------------------------------------------------------


@register
def resolve_keys(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    updates = events.event_tick_update(inputs.stored_events)
    return dimensions.resolve_keys(updates, inputs.tokens(), inputs.pairs()).select("seq", "pair_id", "token_id")


@register
def resolve_pair_unsorted(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    asked = inputs.updates().select("seq", F.col("token1").alias("token_a"), F.col("token0").alias("token_b"))
    return dimensions.resolve_pair_unsorted(asked, inputs.pairs()).select("seq", "pair_id", "token0", "token1")


@register
def pair_orientation(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    turned = F.col("seq") % 2 == 1
    asked = inputs.updates().select(
        "seq",
        F.when(turned, F.col("token1")).otherwise(F.col("token0")).alias("token_a"),
        F.when(F.col("seq") % 5 == 0, F.lit("T99"))
        .when(turned, F.col("token0"))
        .otherwise(F.col("token1"))
        .alias("token_b"),
    )
    found = dimensions.pair_orientation(asked, inputs.pairs())
    return found.withColumn("inverted", F.col("inverted").cast("int"))


@register
def join_event_time(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return inputs.timed(inputs.reserves()).select("seq", "time_unix", "reserves0", "reserves1")


@register
def join_event_msg_time(spark, sf_dir):
    rows = Inputs(spark, sf_dir).swaps()
    return rows.select("seq", "time_unix", F.col("reserves_diff").cast("long"), "msg_type")


@register
def join_pair_tokens(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    tokens, pairs = inputs.tokens(), inputs.pairs()
    numbered = pairs.join(
        tokens.select(F.col("id").alias("token0_id"), F.col("token").alias("token0")), "token0"
    ).join(tokens.select(F.col("id").alias("token1_id"), F.col("token").alias("token1")), "token1")
    by_id = numbered.select("id", "token0_id", "token1_id")
    latest = liquidity.latest_reserves_per_pair(inputs.reserves(), 0, inputs.last)
    return dimensions.join_pair_tokens(by_id, tokens, latest).select(
        "id", "token0", "token1", "reserves0", "reserves1"
    )


@register
def ticks_changed(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    versions = inputs.versions()
    latest = state.latest_tick_state(versions, 0, inputs.last)
    return _state_rows(liquidity.ticks_changed(latest, versions, inputs.half, inputs.last))


@register
def rows_not_in(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    versions = inputs.versions()
    now = _state_rows(state.latest_tick_state(versions, 0, inputs.last)).drop("height")
    before = _state_rows(state.latest_tick_state(versions, 0, inputs.half)).drop("height")
    return liquidity.rows_not_in(now, before)


@register
def time_at_or_before_height(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    asked = inputs.table("orders").select(
        "o_orderkey", (F.col("o_orderkey") % (2 * inputs.max_height) - 5).alias("height")
    )
    return ranges.time_at_height_bulk(asked, inputs.block(), span=100)


@register
def time_after_height(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    asked = [0, 1, inputs.half, inputs.last, inputs.max_height, inputs.max_height + 5]
    return union(
        [
            ranges.time_after_height(inputs.block(), h).select(F.lit(h).cast("long").alias("height"), "time_unix")
            for h in asked
        ]
    )


@register
def time_after_height_bulk(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    asked = inputs.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_orderkey") * 31 % (2 * inputs.max_height) + F.col("l_linenumber") - 5).cast("long").alias("height"),
    )
    return ranges.time_after_height_bulk(asked, inputs.block(), span=100)


@register
def last_block_time(spark, sf_dir):
    return ranges.last_block(fx.blocks(spark, sf_dir))


@register
def height_at_time(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    asked = inputs.table("orders").select(
        "o_orderkey", (F.lit(1704060000) + F.col("o_orderkey") * 977 % 2700000).cast("long").alias("time_unix")
    )
    return ranges.height_at_time_bulk(asked, inputs.block())


@register
def completed_height_at_time(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    asked = [0, inputs.now - 20 * DAY, inputs.now - DAY, inputs.now, inputs.now + DAY]
    return union(
        [
            ranges.completed_height_at_time(inputs.block(), t, inputs.last).select(
                F.lit(t).cast("long").alias("time_unix"), "height"
            )
            for t in asked
        ]
    )


@register
def completed_height_at_time_bulk(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    asked = inputs.table("orders").select(
        "o_orderkey", (F.lit(1704060000) + F.col("o_orderkey") * 977 % 2700000).cast("long").alias("time_unix")
    )
    return ranges.completed_height_at_time_bulk(asked, inputs.block(), inputs.last)


@register
def daily_close_asof(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.volatility_closes(inputs.timed(inputs.price()), inputs.block(), inputs.now, inputs.last)


@register
def asset_match(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    tokens = inputs.updates().select(F.col("token_in").alias("token")).distinct()
    listed = fx.assets(spark, sf_dir)
    newer = listed.where(F.col("p_partkey") % 3 == 0).withColumn("price_id", F.concat("price_id", F.lit("-new")))
    both = newer.withColumn("priority", F.lit(0)).unionByName(listed.withColumn("priority", F.lit(1)))
    return assets.asset_match(tokens, both, _mapping(inputs)).select("token", "base", "display", "price_id")


def _bridged(inputs: Inputs) -> DataFrame:
    path = F.concat(F.lit("transfer/channel-"), F.col("p_size").cast("string"))
    name = fx.token(F.col("p_partkey"))
    return inputs.table("part").select(
        "p_partkey",
        "p_size",
        path.alias("path"),
        name.alias("base_denom"),
        F.upper(F.md5(F.concat(path, F.lit("/"), name))).alias("hash"),
    )


@register
def ibc_asset_match(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    bridged = _bridged(inputs)
    native = bridged.select(F.col("base_denom").alias("token"))
    tokens = bridged.select(F.concat(F.lit("ibc/"), F.col("hash")).alias("token")).unionByName(native)
    chains = bridged.select("path", F.concat(F.lit("chain"), (F.col("p_size") % 4).cast("string")).alias("chain_name"))
    listed = fx.assets(spark, sf_dir).withColumn("priority", F.lit(0))
    return assets.ibc_asset_match(
        tokens, bridged.select("hash", "path", "base_denom"), chains.distinct(), listed
    ).select("token", "base", "dst_channel", "price_id")


def _valued(inputs: Inputs, to_height: int) -> DataFrame:
    latest = liquidity.latest_reserves_per_pair(inputs.reserves(), 0, to_height)
    return liquidity.price_enrich(latest, inputs.unit_prices())


@register
def price_enrich(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return _valued(inputs, inputs.last).select(
        "token0",
        "token1",
        F.round("price0", 12).alias("price0"),
        F.round("price1", 12).alias("price1"),
        F.round("value", 6).alias("value"),
    )


# --- aggregations ----------------------------------------------------------------------------------------------------


@register
def latest_tick_state(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return _state_rows(state.latest_tick_state(inputs.versions(), 0, inputs.last))


@register
def latest_tick_state_since(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return _state_rows(state.latest_tick_state(inputs.versions(), inputs.half, inputs.last))


@register
def latest_reserves_per_pair(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.latest_reserves_per_pair(inputs.reserves(), 0, inputs.last)


@register
def first_seen_ids(spark, sf_dir):
    return Inputs(spark, sf_dir).tokens()


@register
def tick_liquidity(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.tick_liquidity(inputs.versions(), 0, inputs.last)


@register
def tick_liquidity_delta(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.tick_liquidity(inputs.versions(), inputs.half, inputs.last)


@register
def pair_liquidity(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.pair_liquidity(inputs.versions(), 0, inputs.last)


@register
def token_liquidity(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.token_liquidity(inputs.versions(), 0, inputs.last)


@register
def live_reserves_total(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return state.live_reserves_total(state.latest_tick_state(inputs.versions(), 0, inputs.last))


@register
def best_tick(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return state.best_tick(state.latest_tick_state(inputs.versions(), 0, inputs.last))


@register
def ohlc(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.price_series(inputs.timed(inputs.price()), inputs.block(), "hour", 0, inputs.last)


@register
def ohlc_stored(spark, sf_dir):
    """The same from a stored warehouse, whose folders the range prunes."""
    inputs = Inputs(spark, sf_dir)
    house = warehouse.store(inputs.log(), new_folder(spark, "house"))
    return plans.price_series(house.price, house.block, "hour", 0, inputs.last)


def _appended(spark, sf_dir) -> tuple[Inputs, warehouse.Warehouse]:
    """A warehouse of half of the blocks to which the others are added."""
    inputs = Inputs(spark, sf_dir)
    folder = new_folder(spark, "house")
    warehouse.store(inputs.log().where(F.col("height") <= inputs.half), folder)
    return inputs, warehouse.append(inputs.log(), folder)


@register
def append_tick_state(spark, sf_dir):
    _, house = _appended(spark, sf_dir)
    return house.tick_state.select(
        "token0", "token1", "token", "tick", "fee", "height", F.col("reserves").cast("long").alias("reserves")
    )


@register
def append_after_failure(spark, sf_dir):
    """Tick versions, price and reserve rows of an append that ended while it wrote and was run again."""
    inputs = Inputs(spark, sf_dir)
    folder = new_folder(spark, "house")
    warehouse.store(inputs.log().where(F.col("height") <= inputs.half), folder)

    def ends(name):
        if name == "reserves":
            raise InterruptedError(name)

    try:
        warehouse.append(inputs.log(), folder, wrote=ends)
    except InterruptedError:
        house = warehouse.append(inputs.log(), folder)
    shown = {"tick_state": ("reserves", "tick"), "price": ("best0", "best1"), "reserves": ("reserves0", "reserves1")}
    parts = [
        house.tables()[kind].select(
            F.lit(kind).alias("kind"), "height", "token0", "token1",
            F.col(one).cast("double").alias("side0"), F.col(two).cast("double").alias("side1"),
        )
        for kind, (one, two) in shown.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register
def wide_amounts(spark, sf_dir):
    """Changes, tick versions, totals and best prices of a log whose amounts are ``10**40 + 1`` times as large."""
    inputs = Inputs(spark, sf_dir)

    def larger(a):
        far = (a["key"] == "Reserves") & a["value"].rlike("^[1-9]")
        value = F.when(far, F.concat(a["value"], F.lpad(a["value"], 40, "0"))).otherwise(a["value"])
        return F.struct(a["key"].alias("key"), value.alias("value"))

    one = lambda e: F.struct(e["type"].alias("type"), F.transform(e["attributes"], larger).alias("attributes"))
    log = inputs.log().withColumn("events", F.transform("events", one))
    folder = new_folder(spark, "house")
    warehouse.store(log.where(F.col("height") <= inputs.half), folder)
    house = warehouse.append(log, folder)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.col(f"{c}_wide"))
    none = F.lit(None).cast("double")
    shown = {
        "tick_update": (F.concat_ws(" ", text("reserves"), text("reserves_diff")), F.col("tick"), none),
        "tick_state": (text("reserves"), F.col("tick"), F.col("fee")),
        "price": (F.lit(None).cast("string"), F.col("best0"), F.col("best1")),
        "reserves": (F.lit(None).cast("string"), F.col("reserves0"), F.col("reserves1")),
    }
    parts = [
        house.tables()[kind].select(
            F.lit(kind).alias("kind"), "height", "token0", "token1",
            amounts.alias("amounts"), a.cast("double").alias("number0"), b.cast("double").alias("number1"),
        )
        for kind, (amounts, a, b) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@register
def tick_liquidity_stored(spark, sf_dir):
    """Live ticks from the last snapshot and the folder after it."""
    inputs = Inputs(spark, sf_dir)
    house = warehouse.store(inputs.log(), new_folder(spark, "house"), blocks=max(1, inputs.half // 3))
    return liquidity.tick_liquidity(house.tick_state_at(inputs.last), 0, inputs.last)


@register
def pairs_liquidity_stored(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    house = warehouse.store(inputs.log(), new_folder(spark, "house"), blocks=max(1, inputs.half // 3))
    return liquidity.pairs_liquidity(house.reserves_at(inputs.last), inputs.unit_prices(), inputs.last)


@register
def append_tokens(spark, sf_dir):
    return _appended(spark, sf_dir)[1].tokens.select("id", "token", "first_seq")


@register
def append_ohlc(spark, sf_dir):
    inputs, house = _appended(spark, sf_dir)
    return plans.price_series(house.price, house.block, "day", inputs.half, inputs.last)


@register
def ohlc_since(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.price_series(inputs.timed(inputs.price()), inputs.block(), "day", inputs.half, inputs.last)


@register
def tvl_timeseries(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.tvl_series(inputs.timed(inputs.reserves()), inputs.block(), "hour", 0, inputs.last)


@register
def swap_volume_timeseries(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.volume_series(inputs.swaps(), inputs.block(), "hour", 0, inputs.last)


@register
def swap_volume_month(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.volume_series(inputs.swaps(), inputs.block(), "month", 0, inputs.last)


@register
def sample_stddev(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    measured = series.sample_stddev(inputs.updates(), ["token0", "token1"], "reserves")
    return measured.withColumn("stddev", F.round("stddev", 4))


@register
def page_totals(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return paging.page_totals(liquidity.pair_liquidity(inputs.versions(), 0, inputs.last), "side")


@register
def distinct_tokens(spark, sf_dir):
    return dimensions.distinct_tokens(Inputs(spark, sf_dir).loaded())


# --- windows and order-dependent derivations -------------------------------------------------------------------------


@register
def first_last_in_bucket(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return series.first_last_in_bucket(inputs.timed(inputs.price()), "day").select(
        "seq", "bucket", "first_price", "last_price"
    )


@register
def tx_index_in_block(spark, sf_dir):
    return Inputs(spark, sf_dir).txs().select("height", "tx_index", "txhash")


@register
def assign_message(spark, sf_dir):
    return events.assign_message(events.decode_events(Inputs(spark, sf_dir).txs())).select("seq", "msg_seq")


@register
def message_type(spark, sf_dir):
    decoded = events.assign_message(events.decode_events(Inputs(spark, sf_dir).txs()))
    return events.message_type(decoded).select("seq", "msg_type")


@register
def reserves_diff(spark, sf_dir):
    diffs = state.reserves_diff(Inputs(spark, sf_dir).updates())
    return diffs.select("seq", F.col("reserves").cast("long"), F.col("reserves_diff").cast("long"))


@register
def reserves_diff_by_fee(spark, sf_dir):
    diffs = state.reserves_diff(Inputs(spark, sf_dir).updates(), by_fee=True)
    return diffs.select("seq", F.col("reserves").cast("long"), F.col("reserves_diff").cast("long"))


@register
def tick_state_versions(spark, sf_dir):
    return _state_rows(Inputs(spark, sf_dir).versions())


@register
def best_price_series(spark, sf_dir):
    return Inputs(spark, sf_dir).price()


@register
def reserves_series(spark, sf_dir):
    return Inputs(spark, sf_dir).reserves()


@register
def rank_pairs(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.rank_pairs(_valued(inputs, inputs.last)).select("rank", "token0", "token1")


@register
def daily_returns(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    closes = plans.volatility_closes(inputs.timed(inputs.price()), inputs.block(), inputs.now, inputs.last)
    return series.daily_returns(closes).withColumn("change", F.round("change", 9))


# --- composite queries -------------------------------------------------------------------------------------------------


@register
def stats_price_24h(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.stats_price_24h(inputs.timed(inputs.price()), inputs.block(), inputs.now, inputs.last)


@register
def stats_volume_24h(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.stats_volume_24h(inputs.swaps(), inputs.block(), inputs.now, inputs.last)


@register
def stats_tvl_24h(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return plans.stats_tvl_24h(inputs.timed(inputs.reserves()), inputs.block(), inputs.now, inputs.last)


@register
def stats_volatility(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    rows = plans.stats_volatility(inputs.timed(inputs.price()), inputs.block(), inputs.now, inputs.last)
    return rows.withColumn("volatility", F.round("volatility", 9))


@register
def stats_volatility_loose(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    rows = plans.stats_volatility(inputs.timed(inputs.price()), inputs.block(), inputs.now, inputs.last, strict=False)
    return rows.withColumn("volatility", F.round("volatility", 9))


@register
def pairs_liquidity(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.pairs_liquidity(inputs.reserves(), inputs.unit_prices(), inputs.last)


@register
def pairs_liquidity_delta(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return liquidity.pairs_liquidity(inputs.reserves(), inputs.unit_prices(), inputs.last, inputs.half)


# --- scalar functions ----------------------------------------------------------------------------------------------------


def _times(spark, sf_dir) -> DataFrame:
    return fx.market_events(spark, sf_dir).select("seq", F.floor(F.col("micros") / 1000000).cast("long").alias("t"))


@register
def time_bucket(spark, sf_dir):
    plain = [fn.time_bucket("t", r).alias(r) for r in fn.RESOLUTIONS]
    moved = [fn.time_bucket("t", r, 18007).alias(f"{r}_moved") for r in fn.RESOLUTIONS]
    return _times(spark, sf_dir).select("seq", *plain, *moved)


@register
def day_offset(spark, sf_dir):
    return _times(spark, sf_dir).select("seq", fn.day_offset(F.col("t")).alias("day_offset"))


@register
def round_significant(spark, sf_dir):
    price = F.col("l_extendedprice")
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        fn.round_significant(price, 3).alias("digits3"),
        fn.round_significant(price, 4).alias("digits4"),
    )


@register
def tick_to_price(spark, sf_dir):
    tick = F.col("tick") * 100
    return fx.updates(spark, sf_dir).select(
        "seq",
        F.round(fn.tick_to_price(tick), 12).alias("price"),
        F.round(fn.tick_to_price(tick, True), 12).alias("inverted_price"),
    )


@register
def paginate(spark, sf_dir):
    rows = fx.updates(spark, sf_dir).select("seq", "tick")
    return paging.paginate(rows, [F.desc("seq")], offset=10, limit=25)


@register
def paginate_deep(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    order = [F.asc("l_orderkey"), F.asc("l_linenumber")]
    # past the end at small scales, a deep page at larger ones
    return paging.paginate(rows, order, offset=5500, limit=25)


@register
def iso_to_unix(spark, sf_dir):
    return fx.headers(spark, sf_dir).select("height", fn.iso_to_unix("time").alias("time_unix"))


@register
def floor_to_minute(spark, sf_dir):
    t = F.col("t")
    return _times(spark, sf_dir).select(
        "seq", fn.floor_to_minute(t).alias("minute"), fn.floor_to_day(t).alias("day")
    )


@register
def big_int_math(spark, sf_dir):
    large = F.concat(F.col("amount").cast("string"), F.lit("1234567890123456789012345"))
    small = F.col("seq").cast("string")
    difference = fn.amount_difference(fn.amount(large), fn.amount(small))
    return fx.market_events(spark, sf_dir).select(
        "seq", difference.cast("string").alias("difference"), difference.cast("double").alias("as_double")
    )


@register
def denom_exponent(spark, sf_dir):
    units = F.col("denom_units")
    return fx.assets(spark, sf_dir).select(
        "base",
        fn.denom_exponent(units, F.col("base")).alias("base_exponent"),
        fn.denom_exponent(units, F.col("display")).alias("display_exponent"),
        fn.denom_exponent(units, F.lit("nothing")).alias("unknown_exponent"),
    )


@register
def parse_denom(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    denom = F.when(F.col("p_partkey") % 3 == 0, F.col("base_denom")).otherwise(F.concat(F.lit("ibc/"), "hash"))
    path = F.col("path")
    return _bridged(inputs).select(
        "p_partkey",
        fn.bridged_hash(denom).alias("hash"),
        fn.path_port(path).alias("port"),
        fn.path_channel(path).alias("channel"),
    )


@register
def action_path(spark, sf_dir):
    action = F.col("attributes")["action"]
    return Inputs(spark, sf_dir).loaded().select(
        "seq",
        fn.is_message_action(action).cast("int").alias("is_message"),
        fn.message_type_name(action).alias("name"),
    )


@register
def attributes_json(spark, sf_dir):
    rows = Inputs(spark, sf_dir).loaded().select("seq", fn.attributes_json(F.col("attributes")).alias("attributes"))
    again = F.from_json("attributes", "map<string,string>")
    return rows.withColumn("token0", again["TokenZero"])


# --- sorts, limits, pages ------------------------------------------------------------------------------------------------


@register
def order_by_time_desc(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return paging.order_by_time_desc(
        plans.tvl_series(inputs.timed(inputs.reserves()), inputs.block(), "day", 0, inputs.last)
    )


@register
def top_n(spark, sf_dir):
    return paging.top_n(fx.updates(spark, sf_dir).select("seq", "tick"), [F.desc("seq")], 100)


@register
def pages(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    rows = inputs.updates().select("seq", "tick", "token_in")
    order = [F.asc("tick"), F.desc("seq")]
    return paging.pages(rows, order, 1000, inputs.last)


@register
def pages_first(spark, sf_dir):
    """Frames for a client without a known height: small pages."""
    inputs = Inputs(spark, sf_dir)
    rows = inputs.updates().select("seq", "tick", "token_in")
    return paging.feed_pages(rows, [F.asc("tick"), F.desc("seq")], inputs.last)


@register
def pages_two_sided(spark, sf_dir):
    """Both sides cut at the same places; the longer one counts."""
    inputs = Inputs(spark, sf_dir)
    side = F.when(F.col("token_in") == F.col("token0"), 0).otherwise(1).alias("side")
    rows = inputs.updates().select("seq", "tick", side)
    return paging.feed_pages(rows, [F.asc("tick"), F.desc("seq")], inputs.last, side="side")


# --- change feeds ----------------------------------------------------------------------------------------------------------


@register
def completed_blocks(spark, sf_dir):
    return ranges.completed_blocks(fx.updates(spark, sf_dir)).select("seq", "height")


def _frames(inputs: Inputs) -> DataFrame:
    return changes.tick_changes(inputs.changes())


@register
def changes_since(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return changes.changes_since(_frames(inputs), inputs.half, inputs.last).withColumn(
        "reserves", F.col("reserves").cast("long")
    )


@register
def suppress_repeats(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    # frame of a block: the ticks of one side that changed, without their amounts, so that frames do repeat
    rows = _frames(inputs).select(
        F.col("token").alias("feed"), "height", "token0", "token1", F.abs("tick").alias("distance")
    ).distinct()
    feeds = rows.select("feed").distinct()
    due = inputs.block().select("height", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("n")).select(
        fx.token(F.col("n")).alias("feed"), "height"
    )
    return changes.suppress_repeats(rows, due.join(feeds, "feed", "left_semi"), ["feed"])


@register
def accumulate_changes(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    folded = changes.accumulate_changes(
        changes.changes_since(_frames(inputs), 0, inputs.last), changes.TICK
    )
    return folded.withColumn("reserves", F.col("reserves").cast("long"))
