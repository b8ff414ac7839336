"""State derivations against their row-at-a-time definitions, for several chunk sizes and split inputs."""

import pytest
from pyspark.sql import functions as F

from tests import brute
from tidebook.operators import changes as feeds
from tidebook.operators import state

SPANS = [1, 7, 10000]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def log():
    return brute.random_updates(400, seed=3)


@pytest.mark.parametrize("span", SPANS)
def test_reserves_diff(spark, log, span):
    updates = brute.frame(spark, log)
    for by_fee in (False, True):
        found = state.reserves_diff(updates, by_fee, span)
        assert rows_of(found, "seq", "reserves_diff") == sorted(brute.diffs(log, by_fee), key=str)


@pytest.mark.parametrize("span", SPANS)
def test_tick_state_versions(spark, log, span):
    found = state.tick_state_versions(brute.frame(spark, log), span)
    columns = ("token0", "token1", "token", "tick", "fee", "height", "reserves")
    assert rows_of(found, *columns) == sorted(brute.versions(log), key=str)


@pytest.mark.parametrize("span", SPANS)
def test_reserves_series(spark, log, span):
    found = state.reserves_series(brute.frame(spark, log), span)
    columns = ("seq", "token0", "token1", "reserves0", "reserves1")
    assert rows_of(found, *columns) == sorted(brute.reserves_series(log), key=str)


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("seed", [5, 6])
def test_best_price_series(spark, span, seed):
    log = brute.random_updates(300, seed=seed, ticks=10, null_fee=seed == 6)
    found = state.best_price_series(brute.frame(spark, log), span)
    columns = ("seq", "token0", "token1", "best0", "best1", "last")
    assert rows_of(found, *columns) == sorted(brute.price_series(log), key=str)


def test_price_of_a_quiet_live_tick_reaches_far_chunks(spark):
    # a tick set once stays the best one through many chunks that only touch worse ticks
    log = [(0, 1, "A", "B", "B", -5, 1, 7)]
    log += [(i, i * 10, "A", "B", "B", i % 3, 1, (i % 2) * 4 + i) for i in range(1, 60)]
    log += [(100, 5000, "A", "B", "B", -5, 1, 0)]
    found = state.best_price_series(brute.frame(spark, log), 3)
    columns = ("seq", "token0", "token1", "best0", "best1", "last")
    assert rows_of(found, *columns) == sorted(brute.price_series(log), key=str)


def test_frames(spark, log):
    changes = state.state_changes(brute.frame(spark, log), 7)
    columns = ("token0", "token1", "token", "tick", "height", "reserves")
    assert rows_of(feeds.tick_changes(changes, 7), *columns) == sorted(brute.frames(log), key=str)


def test_first_update_with_zero_reserves(spark):
    log = [(0, 1, "A", "B", "A", 3, 1, 0)]
    updates = brute.frame(spark, log)
    assert state.tick_state_versions(updates).count() == 1
    assert state.reserves_diff(updates).count() == 0
    assert state.best_price_series(updates).count() == 0


def test_two_updates_in_one_block_and_two_fees(spark):
    log = [
        (0, 1, "A", "B", "A", 3, 1, 5),
        (1, 1, "A", "B", "A", 3, 1, 9),
        (2, 2, "A", "B", "A", 3, 5, 4),
        (3, 3, "A", "B", "A", 3, 1, 9),
    ]
    updates = brute.frame(spark, log)
    assert rows_of(state.tick_state_versions(updates), "height", "fee", "reserves") == [(1, 1, 9), (2, 5, 4)]
    # the diff looks at the tick without its fee, so the two fees mix
    assert rows_of(state.reserves_diff(updates), "seq", "reserves_diff") == [(0, 5), (1, 4), (2, -5), (3, 5)]


def test_side_becomes_empty(spark):
    log = [(0, 1, "A", "B", "A", 3, 1, 5), (1, 2, "A", "B", "B", 4, 1, 5), (2, 3, "A", "B", "A", 3, 1, 0)]
    updates = brute.frame(spark, log)
    last = [r for r in state.best_price_series(updates).collect() if r["seq"] == 2][0]
    assert (last["best0"], last["best1"], last["last"]) == (None, 4, 4)
    total = [r for r in state.reserves_series(updates).collect() if r["seq"] == 2][0]
    assert (total["reserves0"], total["reserves1"]) == (0.0, 5.0)


def test_latest_state_snapshot_is_earlier_snapshot_plus_changes(spark, log):
    updates = brute.frame(spark, log)
    changes = state.state_changes(updates)
    versions = state.versions_of_changes(changes)
    middle, end = 300, 10**6
    frames = feeds.tick_changes(changes)
    early = feeds.changes_since(frames, 0, middle).groupBy(*feeds.TICK).agg(
        F.max_by("reserves", "height").alias("reserves"), F.lit(middle).cast("long").alias("height")
    )
    late = feeds.changes_since(frames, middle, end).select(*feeds.TICK, "reserves", "height")
    folded = feeds.accumulate_changes(early.unionByName(late), feeds.TICK)
    live = state.live_ticks(state.latest_tick_state(versions, 0, end))
    summed = live.groupBy(*feeds.TICK).agg(F.sum("reserves").alias("reserves"))
    assert rows_of(folded, *feeds.TICK, "reserves") == rows_of(summed, *feeds.TICK, "reserves")
    totals = state.live_reserves_total(state.latest_tick_state(versions, 0, end))
    assert totals.count() == summed.select("token0", "token1", "token").distinct().count()
    best = {(r["token0"], r["token"]): r["tick"] for r in state.best_tick(live).collect()}
    for row in summed.collect():
        assert best[(row["token0"], row["token"])] <= row["tick"]


def test_upsert_latest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, n long, v string")
    assert rows_of(state.upsert_latest(rows, ["k"], "n"), "k", "n", "v") == [("a", 3, "y"), ("b", 2, "z")]


@pytest.mark.parametrize("span", [1, 50, 10000])
def test_best_ticks_of_long_chunks_and_shared_fees(spark, span):
    # many turns in one chunk, few ticks with several fees each, so that ranges of every length overlap
    log = brute.random_updates(900, seed=11, ticks=4)
    found = state.best_price_series(brute.frame(spark, log), span)
    columns = ("seq", "token0", "token1", "best0", "best1", "last")
    assert rows_of(found, *columns) == sorted(brute.price_series(log), key=str)
