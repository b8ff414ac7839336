"""Shapes of the physical plans that matter at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tests import brute
from tidebook.operators import dimensions, events, ranges, state
from tidebook.plans import queries as plans
from tidebook.schemas import TABLES, TX_LOG
from tidebook.sources import placed, tables


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def updates(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "updates")
    brute.frame(spark, brute.random_updates(50, 1)).write.parquet(path)
    return spark.read.parquet(path)


def test_windows_never_run_over_a_key_alone(updates):
    for df in (state.state_changes(updates), state.reserves_diff(updates)):
        text = plan(df)
        # rows are shuffled by key and chunk; the only exchange by key alone carries chunk summaries
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert text.count("Window") and "partial_max_by" in text


def test_versions_reuse_the_partitioning_of_the_changes(updates):
    changes = plan(state.state_changes(updates)).count("Exchange")
    assert plan(state.tick_state_versions(updates)).count("Exchange") == changes


def test_series_scan_gets_literal_bounds_and_few_columns(spark, tmp_path):
    rows = [(h, h, "A", "B", 1, 2, 1, h * 60) for h in range(1, 30)]
    price = spark.createDataFrame(
        rows, "height long, seq long, token0 string, token1 string, best0 int, best1 int, last int, time_unix long"
    )
    tables.write_table(price, str(tmp_path / "price"), ["token0", "token1", "seq"])
    stored = tables.read_table(spark, str(tmp_path / "price"), TABLES["price"])
    block = price.select("height", "time_unix")
    text = plan(plans.price_series(stored, block, "hour", 5, 20, token_a="A", token_b="B"))
    assert "GreaterThanOrEqual(time_unix,0)" in text and "LessThanOrEqual(time_unix,1200)" in text
    schema = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    assert "best0" not in schema and "height:" not in schema
    ranged = tables.read_table(spark, str(tmp_path / "price"), TABLES["price"], 5, 20)
    assert "PartitionFilters: [isnotnull(height_range" in plan(ranged)
    assert "PushedFilters: [IsNotNull(height)" in plan(ranged)


def test_ranges_prune_the_folders_of_stored_tables(spark, tmp_path):
    rows = [(h, h, "A", "B", 1, 2, 1, h * 60) for h in range(1, 400)]
    price = spark.createDataFrame(
        rows, "height long, seq long, token0 string, token1 string, best0 int, best1 int, last int, time_unix long"
    )
    tables.write_table(price, str(tmp_path / "price"), ["token0", "token1", "seq"], span=100)
    stored = tables.read_table(spark, str(tmp_path / "price"), TABLES["price"], span=100)
    block = price.select("height", "time_unix")
    asked = [
        plans.price_series(stored, block, "hour", 240, 290),
        plans.stats_price_24h(stored, block, 399 * 60, 398),
        ranges.block_range(stored, 210, 260),
        ranges.time_range(stored, block, 398, after=220 * 60, before=280 * 60),
    ]
    expected = [
        plans.price_series(price, block, "hour", 240, 290),
        plans.stats_price_24h(price, block, 399 * 60, 398),
        ranges.block_range(price, 210, 260),
        ranges.time_range(price, block, 398, after=220 * 60, before=280 * 60),
    ]
    for df, right in zip(asked, expected, strict=True):
        filters = [line for line in plan(df).splitlines() if line.startswith("PartitionFilters")]
        assert any("height_range" in line and "ubquery" in line or ">= " in line for line in filters)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, right.select(df.columns).collect()))


def few_records(spark, path):
    attributes = [("action", "/neutron.dex.MsgDeposit"), ("module", "dex")]
    rows = [(i, i // 3, f"h{i}", "2024-01-01T00:00:01Z", 5 * (i % 7 == 6), "", "", "1", "1", [("message", attributes)] * (i % 4)) for i in range(60)]
    spark.createDataFrame(rows, TX_LOG).write.parquet(path)
    return spark.read.schema(TX_LOG).parquet(path)


@pytest.fixture
def no_broadcast(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


def test_decoding_a_placed_log_shuffles_nothing(spark, tmp_path, no_broadcast):
    log = few_records(spark, str(tmp_path / "log"))
    placed.store_placed(log, str(tmp_path / "placed"), blocks=10)
    laid_out = placed.read_placed(spark, str(tmp_path / "placed"), blocks=10)
    found = events.load_events(events.tx_index_in_block(events.valid_txs(laid_out)))
    for df in (found, events.event_tick_update(found), events.dex_events(found), events.load_txs(laid_out)):
        text = plan(df)
        assert "Exchange" not in text and "Window" not in text and "Join" not in text
        assert text.count("Location:") == 1
    expected = events.load_events(events.valid_txs(log)).select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and found.count() == sum(i % 4 for i in range(60) if i % 7 != 6)
    filters = plan(events.load_events(placed.read_placed(spark, str(tmp_path / "placed"), 10, 15, blocks=10)))
    assert "PartitionFilters: [isnotnull(height_range" in filters and "GreaterThan(height,10)" in filters


def test_storing_a_placed_log_moves_records_once(spark, tmp_path, no_broadcast):
    log = few_records(spark, str(tmp_path / "log"))
    text = plan(events.with_places(tables.spread_by_runs(log, 10), tables.RANGE, tables.RUN))
    assert text.count("Exchange\n") == 1 and text.count("Sort\n") == 1


def test_decoding_another_log_moves_records_once_and_undecoded(spark, tmp_path, no_broadcast):
    log = few_records(spark, str(tmp_path / "log"))
    text = plan(events.event_tick_update(events.load_events(events.tx_index_in_block(events.valid_txs(log)))))
    assert text.count("Location:") == 1 and "Join" not in text
    moved = [part for part in text.split("\n\n") if "Exchange\n" in part]
    assert len(moved) == 1 and "attributes#" not in moved[0]
    assert "SortAggregate" not in plan(events.load_blocks(log))


def test_decoding_makes_the_map_of_an_event_and_the_openings_of_a_transaction_once(spark, tmp_path):
    log = few_records(spark, str(tmp_path / "log"))
    found = events.load_events(events.valid_txs(log))
    # no filter on an attribute repeats them
    text = events.event_tick_update(found)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("map_from_entries") == 1
    opened = [line for line in text.splitlines() if "reverse(filter(" in line]
    assert len(opened) == 1 and opened[0].count("reverse(filter(") == 1 and "_starts" in opened[0]


def test_dictionaries_are_found_once(spark, tmp_path):
    loaded = events.load_events(events.valid_txs(few_records(spark, str(tmp_path / "log"))))
    for found in (dimensions.first_seen_tokens(loaded), dimensions.first_seen_pairs(loaded)):
        assert "Location:" not in plan(found)  # only the entries are read, as often as the dictionary is joined


def test_one_key_is_spread_over_tasks(spark):
    log = [(i, i, "A", "B", "A", 1, 1, i % 5) for i in range(400)]
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        changes = state.state_changes(brute.frame(spark, log), span=10)
        sizes = [r["count"] for r in changes.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set(setting, before)
    assert len(sizes) == 4 and max(sizes) < 250
