"""Build and store the warehouse from the transaction log."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.wide import is_large, shown, unshown, wide_zero, widened
from tidebook.operators import dimensions, events, state
from tidebook.operators.ordered import DEFAULT_SPAN
from tidebook.operators.snapshots import since_snapshot, snapshots
from tidebook.schemas import AMOUNT, CARRIED, MESSAGE_TYPES, TABLES
from tidebook.session import scratch, tasks_for
from tidebook.sources import versions
from tidebook.sources.placed import RECORDS_PER_TASK
from tidebook.sources.tables import RANGE_SPAN, read_table, without_folders, write_folders, write_table


@dataclass
class Warehouse:
    """All warehouse tables. Tables with a time carry it, so queries need no join to find it."""

    block: DataFrame
    tx: DataFrame
    tx_msg_type: DataFrame
    tx_msg: DataFrame
    events: DataFrame
    tokens: DataFrame
    pairs: DataFrame
    deposit: DataFrame
    withdraw: DataFrame
    place_order: DataFrame
    tick_update: DataFrame
    rejected: DataFrame
    tick_state: DataFrame
    price: DataFrame
    reserves: DataFrame
    tick_snapshot: DataFrame
    reserves_snapshot: DataFrame

    def newest(self) -> int:
        return self.block.agg(F.max("height")).first()[0] or 0

    def tick_state_at(self, to_height: int, from_height: int = 0) -> DataFrame:
        """Tick versions for queries at a height, and on changes since another one; for a stored warehouse."""
        return since_snapshot(self.tick_state, self.tick_snapshot, self.newest(), to_height, from_height)

    def reserves_at(self, to_height: int, from_height: int = 0) -> DataFrame:
        """Reserve rows for queries at one or two heights."""
        return since_snapshot(self.reserves, self.reserves_snapshot, self.newest(), to_height, from_height)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# Sort columns of the stored tables; they decide which Parquet row groups a query can skip.
SORT = {
    "block": ["height"],
    "tx": ["height", "tx_index"],
    "tx_msg": ["seq"],
    "events": ["seq"],
    "deposit": ["token0", "token1", "seq"],
    "withdraw": ["token0", "token1", "seq"],
    "place_order": ["token0", "token1", "seq"],
    "tick_update": ["token0", "token1", "seq"],
    "rejected": ["seq"],
    "tick_state": ["token0", "token1", "token", "tick", "height"],
    "price": ["token0", "token1", "seq"],
    "reserves": ["token0", "token1", "seq"],
}
SNAPSHOTS = {
    "tick_snapshot": ("tick_state", [*state.PAIR, "token", "tick", "fee"]),
    "reserves_snapshot": ("reserves", state.PAIR),
}
#: Tables of a commit that are written at the same time.
SIDE_BY_SIDE = 6
# Attributes of amounts that can be too long for a decimal.
WIDE_TEXTS = {
    "deposit": {"deposited0": "ReservesZeroDeposited", "deposited1": "ReservesOneDeposited", "shares": "SharesMinted"},
    "withdraw": {
        "withdrawn0": "ReservesZeroWithdrawn",
        "withdrawn1": "ReservesOneWithdrawn",
        "shares_removed": "SharesRemoved",
    },
    "place_order": {"amount_in": "AmountIn", "shares": "Shares"},
}
#: The events that ask for a pair, by their kind.
FLAGGED = ("PlaceLimitOrder", "DepositLP", "WithdrawLP")
DICTIONARIES = ("tokens", "pairs", "tx_msg_type")


def message_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a) for a, i in MESSAGE_TYPES.items()], "id int, action string")


def messages(loaded: DataFrame) -> DataFrame:
    """One row per message: its sequence number and type."""
    return loaded.where(F.col("seq") == F.col("msg_seq")).select("seq", "height", F.col("msg_type").alias("type"))


def decoded_events(log: DataFrame) -> DataFrame:
    """Events of successful transactions with message and block time, from transaction records with a time."""
    txs = events.tx_index_in_block(events.valid_txs(log))
    timed = txs.withColumn("time_unix", events.iso_to_unix("timestamp"))
    return events.load_events(timed)


def _spread(log: DataFrame, tasks: int) -> DataFrame:
    """Records by block in a number of tasks that follows from their count; a placed log is decoded where it lies."""
    return log if events.is_placed(log) else events.valid_txs(log).repartition(tasks, "height")


def _flagged(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events with their pair ids; only kinds that can ask for a pair are looked up."""
    asking = F.col("kind").isin(*FLAGGED)
    none = {f"pair_{a}": F.lit(0).cast("long") for a in ("swap", "deposit", "withdraw")}
    looked_up = events.pair_action_flags(found.where(asking).drop("kind"), pairs)
    return looked_up.unionByName(found.where(~asking).drop("kind").withColumns(none))


def _snapshots(name: str, rows: DataFrame, blocks: int, newest: int, after: int = -1) -> DataFrame:
    live = state.is_live(rows) if name == "tick_snapshot" else None
    return snapshots(rows, SNAPSHOTS[name][1], "seq", blocks, newest, after, live)


def large_pairs(updates: DataFrame, wide: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Pairs with an amount, now or carried, that has to be counted in limbs."""
    ticks, totals = known["carried_ticks"], known["carried_totals"]
    large = [
        wide,
        updates.where(is_large(updates, "reserves")),
        ticks.where(is_large(ticks, "reserves")),
        totals.where(is_large(totals, "reserves0") | is_large(totals, "reserves1")),
    ]
    return reduce(DataFrame.unionByName, [rows.select(*state.PAIR) for rows in large]).distinct()


def derived(
    updates: DataFrame,
    known: dict[str, DataFrame],
    span: int,
    working: Callable[[str, DataFrame], DataFrame],
    wide: bool,
) -> dict[str, DataFrame]:
    """What follows from tick updates and the carried tables, with amounts in one form: as decimals or as limbs."""
    if wide:
        amounts = {"carried_marks": ["reserves"], "carried_ticks": ["reserves"], "carried_totals": state.RESERVES}
        known = known | {name: unshown(known[name], *columns) for name, columns in amounts.items()}
    name = "large-changes" if wide else "changes"
    changes = working(name, state.state_changes(updates, span, known["carried_ticks"]))
    zero = F.lit(0).cast(AMOUNT) if not wide else wide_zero()
    sums = changes.select(*state.PAIR, *state.side_changes(F.col("token_in") == F.col("token0"), zero))
    totals = known["carried_totals"].select(*state.PAIR, *state.TOTALS)
    return {
        "tick_update": shown(
            state.reserves_diff(updates, span=span, carry=known["carried_marks"]), "reserves", "reserves_diff"
        ),
        "tick_state": shown(state.versions_of_changes(changes), "reserves"),
        "reserves": state.reserves_of_changes(changes, span, known["carried_totals"]),
        "turns": state.live_turns(changes),
        "carried_totals": shown(state.summed_totals(totals.unionByName(sums)), *state.RESERVES),
    }


def derived_in_parts(
    updates: DataFrame,
    wide: DataFrame,
    known: dict[str, DataFrame],
    span: int,
    working: Callable[[str, DataFrame], DataFrame],
) -> dict[str, DataFrame]:
    """The same for all pairs. Pairs without large amounts keep plain decimals; the others, if there are any, are counted
    in limbs, all of their rows, so that every difference and total is exact."""
    large = working("large-pairs", large_pairs(updates, wide, known))
    if large.isEmpty():
        return derived(updates, known, span, working, wide=False)
    own = {"carried_marks", "carried_ticks", "carried_totals"}
    split = lambda rows, how: rows.join(large, state.PAIR, how)
    some = updates.withColumn("reserves", widened(F.col("reserves")))
    parts = [
        derived(
            split(updates, "left_anti"),
            known | {name: split(known[name], "left_anti").select(known[name].columns) for name in own},
            span,
            working,
            wide=False,
        ),
        derived(
            split(some, "left_semi").unionByName(wide),
            known | {name: split(known[name], "left_semi").select(known[name].columns) for name in own},
            span,
            working,
            wide=True,
        ),
    ]
    return {name: parts[0][name].unionByName(parts[1][name]) for name in parts[0]}


class _Writer:
    """Writes the tables of one commit; nothing of them is read before ``publish``."""

    def __init__(self, spark: SparkSession, folder: str, span: int, blocks: int, wrote: Callable[[str], None] | None):
        self.spark, self.folder, self.span, self.blocks = spark, folder, span, blocks
        self.commit, self.wrote = versions.new_commit(), wrote or (lambda name: None)
        #: tasks that write a table by runs of blocks, once the size of the log is known
        self.tasks: int | None = None

    def path(self, name: str) -> str:
        return versions.commit_folder(self.folder, name, self.commit)

    def table(self, name: str, rows: DataFrame) -> DataFrame:
        """Write the rows that this commit adds to a table and return them as stored."""
        if name in SNAPSHOTS:
            write_folders(rows, self.path(name), SNAPSHOTS[name][1])
        elif name in SORT:
            write_table(rows, self.path(name), SORT[name], self.blocks, tasks=self.tasks)
        else:
            rows.write.parquet(self.path(name))
        self.wrote(name)
        return self.added(name)

    def tables(self, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The same for tables that do not depend on each other: their jobs run side by side."""
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            running = {name: pool.submit(self.table, name, table) for name, table in rows.items()}
        return {name: job.result() for name, job in running.items()}

    def added(self, name: str) -> DataFrame:
        if name in SORT:
            return without_folders(read_table(self.spark, f"{self.folder}/{name}", TABLES[name], commits=[self.commit]))
        return versions.read_commits(self.spark, self.folder, name, (TABLES | CARRIED)[name], [self.commit])


def store(
    log: DataFrame,
    folder: str,
    span: int = DEFAULT_SPAN,
    blocks: int = RANGE_SPAN,
    wrote: Callable[[str], None] | None = None,
) -> Warehouse:
    """Write all tables under a folder, in folders of ``blocks`` blocks, and return them as read back.

    Tables that are there already are replaced when all new ones are written, see ``append``.
    """
    before = versions.newest_version(log.sparkSession, folder)
    number = 0 if before is None else before.number
    return _commit(log, folder, span, versions.Version(number=number, blocks=blocks), wrote)


def append(
    log: DataFrame, folder: str, span: int = DEFAULT_SPAN, wrote: Callable[[str], None] | None = None
) -> Warehouse:
    """Add the blocks of ``log`` that are newer than those of a stored warehouse; older ones are ignored.

    Only new blocks are decoded and only new rows written. Every derivation starts from the carried tables, which have
    one row per key and are written anew by each commit, so no table of the history is read. All tables change at once
    with the new version: an append that ends early at any place changes nothing and can be run again, and readers
    meanwhile see the old tables. Of two appends at the same time one fails with ``VersionTaken``. ``wrote`` is told the
    name of each table that has been written. The last height of a log that still grows has to be left out.
    """
    before = versions.newest_version(log.sparkSession, folder)
    if before is None:
        raise ValueError(f"no warehouse is stored in {folder}")
    return _commit(log, folder, span, before, wrote)


def _commit(
    log: DataFrame, folder: str, span: int, before: versions.Version, wrote: Callable[[str], None] | None
) -> Warehouse:
    """Derive what a log adds to a version, write it as one commit and publish the next version.

    The decoded events are written early and everything else is derived from the written table: the nested log is
    decoded once, and a lost executor never makes the job decode it again. They, the parsed tick updates and the change
    log are working tables in the shared folder that go at the end. The number of transactions, written before, gives the
    tasks of the decoding and of the tables, so that none has more to sort when the log is larger.
    """
    spark = log.sparkSession
    blocks = before.blocks or RANGE_SPAN
    house, known = _load(spark, folder, before), carried(spark, folder, before)
    log = log.where(F.col("height") > (-1 if before.newest is None else before.newest))
    writer = _Writer(spark, folder, span, blocks, wrote)
    with scratch(spark, "commit") as work:

        def working(name: str, table: DataFrame, *folders: str) -> DataFrame:
            table.write.partitionBy(*folders).parquet(f"{work}/{name}")
            writer.wrote(name)
            return spark.read.schema(table.schema).parquet(f"{work}/{name}")

        txs = writer.table("tx", events.load_txs(log))
        writer.tasks = tasks_for(spark, txs.count(), RECORDS_PER_TASK)
        # folders by kind: what derives from one kind of event reads the attributes of no other
        found = working("decoded", decoded_events(_spread(log, writer.tasks)).withColumn("kind", events.event_kind()), "kind")

        def of_kind(*kinds: str) -> DataFrame:
            return found.where(F.col("kind").isin(*kinds)).drop("kind")

        block = writer.table("block", events.load_blocks(events.valid_txs(log)))
        now = block.agg(F.max("height")).first()[0]
        newest = before.newest if now is None else now
        parsed = working("parsed", events.parsed_tick_updates(of_kind("TickUpdate")))
        updates, wide = events.decimal_updates(parsed), events.wide_updates(parsed)
        states = derived_in_parts(updates, wide, known, span, working)
        all_kinds = found.drop("kind")
        writer.table("tokens", dimensions.new_tokens(all_kinds, house.tokens, span))
        pairs = house.pairs.unionByName(writer.table("pairs", dimensions.new_pairs(all_kinds, house.pairs, span)))
        best = known["carried_best"].withColumns({"given0": F.lit(True), "given1": F.lit(True)})
        # for best prices only the fact counts that a tick is live
        live = known["carried_ticks"].withColumn("reserves", state.is_live(known["carried_ticks"]).cast("int"))
        price = state.best_price_of_turns(states["turns"], span, live, best)
        deposits, withdrawals, orders = of_kind("DepositLP"), of_kind("WithdrawLP"), of_kind("PlaceLimitOrder")
        new = {
            "tx_msg": messages(all_kinds),
            "events": _flagged(found, pairs),
            "deposit": events.with_wide_texts(events.event_deposit(deposits), deposits, WIDE_TEXTS["deposit"]),
            "withdraw": events.with_wide_texts(events.event_withdraw(withdrawals), withdrawals, WIDE_TEXTS["withdraw"]),
            "place_order": events.with_wide_texts(events.event_place_order(orders), orders, WIDE_TEXTS["place_order"]),
            "tick_update": states["tick_update"],
            "rejected": events.rejected_updates(parsed),
            "tick_state": states["tick_state"],
            "price": dimensions.join_event_time(price, block),
            "reserves": dimensions.join_event_time(states["reserves"], block),
        }
        added = writer.tables(new)
        rest = _carried_on(known, added, states["carried_totals"])
        done = -1 if before.newest is None else before.newest // blocks
        for name, (source, _) in SNAPSHOTS.items():
            start = known["carried_ticks" if source == "tick_state" else "carried_reserves"]
            rows = start.withColumnRenamed("token_in", "token").unionByName(added[source])
            rest[name] = _snapshots(name, rows, blocks, -1 if newest is None else newest, done)
        writer.tables(rest)
    once = ["tx_msg_type"] if "tx_msg_type" not in before.commits else []
    for name in once:
        writer.table(name, message_types(spark))
    adds = ["tx", "block", "tokens", "pairs", *new, *SNAPSHOTS, *once]
    after = replace(before.following(writer.commit, adds, list(CARRIED), newest), blocks=blocks)
    versions.publish(spark, folder, after)
    return load(spark, folder)


def carried(spark: SparkSession, folder: str, version: versions.Version) -> dict[str, DataFrame]:
    """What derivations of later blocks have to know of a version, one small row per key: the last reserves of each tick
    (``marks`` without the fee, ``ticks`` with it, also of empty ones), the totals and best ticks of each pair and its
    newest row of reserves."""
    return {
        name: versions.read_commits(spark, folder, name, schema, version.commits.get(name, []))
        for name, schema in CARRIED.items()
    }


def _carried_on(known: dict[str, DataFrame], added: dict[str, DataFrame], totals: DataFrame) -> dict[str, DataFrame]:
    """The carried tables after the added rows, from those before them."""

    def newest(name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        old = known[name]
        return state.upsert_latest(old.unionByName(rows.select(old.columns)), keys, "seq").select(old.columns)

    marks = newest("carried_marks", added["tick_update"], state.TICK)
    return {
        "carried_marks": marks.where(state.is_live(marks)),
        "carried_ticks": newest("carried_ticks", added["tick_state"].withColumnRenamed("token", "token_in"), state.STATE),
        "carried_totals": totals.select(known["carried_totals"].columns),
        "carried_best": newest("carried_best", added["price"], state.PAIR),
        "carried_reserves": newest("carried_reserves", added["reserves"], state.PAIR),
    }


def compact(spark: SparkSession, folder: str) -> Warehouse:
    """Write the rows of many small commits as one, with the files of a single ``store``; the tables stay the same."""
    before = versions.newest_version(spark, folder)
    if before is None:
        raise ValueError(f"no warehouse is stored in {folder}")
    writer = _Writer(spark, folder, DEFAULT_SPAN, before.blocks, None)
    for name, table in _load(spark, folder, before).tables().items():
        writer.table(name, table if name in SNAPSHOTS else without_folders(table))
    versions.publish(spark, folder, before.following(writer.commit, [], list(TABLES), before.newest))
    return load(spark, folder)


def load(spark: SparkSession, folder: str, from_height: int = 0, to_height: int | None = None) -> Warehouse:
    """Open the newest version of a stored warehouse; later writes do not change what was opened."""
    version = versions.newest_version(spark, folder)
    if version is None:
        raise ValueError(f"no warehouse is stored in {folder}")
    return _load(spark, folder, version, from_height, to_height)


def _load(
    spark: SparkSession, folder: str, version: versions.Version, from_height: int = 0, to_height: int | None = None
) -> Warehouse:
    found = {}
    for name, schema in TABLES.items():
        commits = version.commits.get(name, [])
        if name in DICTIONARIES:
            found[name] = versions.read_commits(spark, folder, name, schema, commits)
            continue
        heights = (0, None) if name in SNAPSHOTS else (from_height, to_height)
        found[name] = read_table(spark, f"{folder}/{name}", schema, *heights, version.blocks or RANGE_SPAN, commits)
    return Warehouse(**found)
