"""A followed log gives the rows of a full run."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests import brute
from tidebook.operators import changes, state
from tidebook.streaming import windows
from tidebook.streaming.follow import UPDATE, CompletedBlocks, TickBook, finish, follow
from tidebook.streaming.state_table import BatchOutput, StateTable


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_followed_book_equals_full_run(spark, tmp_path):
    log = brute.random_updates(120, seed=11, null_fee=True)
    updates = brute.frame(spark, log)
    arrived = str(tmp_path / "arrived")
    # the cuts fall inside blocks
    for low, high in ((0, 50), (50, 71), (71, 120)):
        updates.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(arrived)
    stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(arrived)
    gate = CompletedBlocks(spark, str(tmp_path / "gate"))
    book = TickBook(spark, str(tmp_path / "book"), span=5, compact_every=2)
    query = follow(stream, book.advance, gate, str(tmp_path / "checkpoint"), available_now=True)
    query.awaitTermination()
    batches = query.lastProgress["batchId"] + 1
    assert batches == 3
    seen = book.read("tick_state").agg(F.max("height")).first()[0]
    assert seen < log[-1][1]  # the open block is held back
    finish(book.advance, gate, batches)

    # a batch that runs again after a failure leaves the same rows
    book.advance(gate.rest(batches), batches)

    diff = state.reserves_diff(updates)
    assert rows_of(book.read("tick_update"), ["seq", "reserves_diff"]) == rows_of(diff, ["seq", "reserves_diff"])
    all_changes = state.state_changes(updates)
    columns = ["token0", "token1", "token", "tick", "fee", "height", "reserves"]
    assert rows_of(book.read("tick_state"), columns) == rows_of(state.versions_of_changes(all_changes), columns)
    columns = ["seq", "token0", "token1", "best0", "best1", "last"]
    assert rows_of(book.read("price"), columns) == sorted(brute.price_series(log), key=str)
    found = book.read("reserves").select(
        "seq", "token0", "token1", F.col("reserves0").cast("double"), F.col("reserves1").cast("double")
    )
    assert rows_of(found, found.columns) == sorted(brute.reserves_series(log), key=str)
    columns = ["token0", "token1", "token", "tick", "height", "reserves"]
    assert rows_of(book.read("frames"), columns) == rows_of(changes.tick_changes(all_changes), columns)


def test_state_before_the_first_batch_takes_no_task(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), ["k"], "k string, v decimal(38,0)")
    gate = CompletedBlocks(spark, str(tmp_path / "gate"))
    for empty in (table.before(0), gate.rest(0)):
        assert "LocalRelation <empty>" in empty._jdf.queryExecution().optimizedPlan().toString()
        assert empty.rdd.getNumPartitions() == 0 and empty.count() == 0
    assert [(f.name, f.dataType.simpleString()) for f in table.before(0).schema] == [("k", "string"), ("v", "decimal(38,0)")]
    gate.complete(brute.frame(spark, brute.random_updates(60, seed=3)), 0)
    assert gate.handed_on.of(0).count() == 1 and len(list((tmp_path / "gate/handed-on/batch=0").glob("*.parquet"))) == 1


def test_late_blocks_end_the_stream_instead_of_changing_state(spark, tmp_path):
    updates = brute.frame(spark, brute.random_updates(60, seed=3))
    gate = CompletedBlocks(spark, str(tmp_path / "gate"))
    heights = sorted(r[0] for r in updates.select("height").distinct().collect())
    early, late, rest = heights[: len(heights) // 2], heights[2], heights[len(heights) // 2 :]
    first = updates.where(F.col("height").isin(early) & (F.col("height") != late))
    assert gate.complete(first, 0).count() > 0
    assert gate.last_handed_on(1) == early[-1] - 1
    with pytest.raises(ValueError, match=f"block {late} arrived after"):
        gate.complete(updates.where((F.col("height") == late) | F.col("height").isin(rest)), 1)
    # rows of the open block may still come, and a batch can run again
    for _ in range(2):
        assert gate.complete(updates.where(F.col("height") >= early[-1]), 1).agg(F.min("height")).first()[0] == early[-1]
    gate.complete(updates.limit(0), 2)
    assert gate.last_handed_on(3) == heights[-1] - 1


def test_state_table_compacts(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), ["k"], "k string, v long", compact_every=2)
    for batch, rows in enumerate([[("a", 1)], [("b", 2)], [("a", 3)], [("c", 4)], [("b", 5)], []]):
        table.write(batch, spark.createDataFrame(rows, "k string, v long"))
    assert table.before(0).count() == 0
    assert rows_of(table.before(2), ["k", "v"]) == [("a", 1), ("b", 2)]
    assert rows_of(table.before(3), ["k", "v"]) == [("a", 3), ("b", 2)]
    assert rows_of(table.before(6), ["k", "v"]) == [("a", 3), ("b", 5), ("c", 4)]


PRICES = "seq long, token0 string, token1 string, time_unix long, last int"


def prices(n):
    return [(i, "A", f"B{i % 3}", i * 400, i * 7 % 100) for i in range(n)]


def run_windows(spark, path, folder, limit=None):
    reader = spark.readStream.schema(PRICES)
    stream = (reader.option("maxFilesPerTrigger", limit) if limit else reader).parquet(path)
    return windows.write_updates(windows.ohlc_windows(stream, "1 hour"), f"{folder}/out", f"{folder}/checkpoint", available_now=True)


def test_batches_of_many_files_give_the_windows_of_one_read(spark, tmp_path):
    rows = prices(240)
    output = BatchOutput(spark, str(tmp_path / "rows"), PRICES)
    expected = {}
    for i, token0, token1, time, last in rows:
        first = expected.setdefault((token1, time // 3600 * 3600), [last, last, last, last])
        first[1:] = [max(first[1], last), min(first[2], last), last]
    for batch, (low, high) in enumerate(((0, 90), (90, 100), (100, 240))):
        part = spark.createDataFrame(rows[low:high], PRICES).repartition(5, "seq")  # no file is in the order of time
        for _ in range(2):  # a batch that runs again writes nothing new
            assert output.write(batch, part).count() == high - low
        query, found = run_windows(spark, output.folder, str(tmp_path / "windows"))
        windows.end(query)
    columns = ["token1", "time_unix", "open", "high", "low", "close"]
    assert rows_of(windows.current_windows(found), columns) == sorted(((*k, *v) for k, v in expected.items()), key=str)
    assert output.read().count() == 240


def test_a_torn_batch_is_an_error(spark, tmp_path):
    output = BatchOutput(spark, str(tmp_path / "rows"), PRICES)
    output.write(0, spark.createDataFrame(prices(240), PRICES).repartition(4, "seq"))
    with pytest.raises((windows.LateRows, StreamingQueryException)):
        windows.end(run_windows(spark, output.folder, str(tmp_path / "windows"), limit=1)[0])


def test_windows_are_updated(spark, tmp_path):
    arrived = str(tmp_path / "prices")
    schema = "seq long, token0 string, token1 string, time_unix long, last int"
    for rows in ([(1, "A", "B", 10, 5), (2, "A", "B", 20, 9)], [(3, "A", "B", 30, 1), (4, "A", "B", 4000, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arrived)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    query, output = windows.write_updates(
        windows.ohlc_windows(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True
    )
    query.awaitTermination()
    found = rows_of(windows.current_windows(output), ["time_unix", "open", "high", "low", "close"])
    assert found == [(0, 5, 9, 1, 1), (3600, 2, 2, 2, 2)]
