"""What a commit of the warehouse reads and how its tables are spread."""

from pyspark.sql import functions as F

from tests.test_plans import plan
from tidebook.operators import events
from tidebook.sources import placed, tables


def decoded(spark, *maps):
    rows = [(i, 1, m.pop("type"), m) for i, m in enumerate(maps)]
    return spark.createDataFrame(rows, "seq long, height long, type string, attributes map<string,string>")


def update(reserves):
    return {"type": "TickUpdate", "module": "dex", "action": "TickUpdate", "TokenZero": "A", "TokenOne": "B", "TokenIn": "A",
            "TickIndex": "1", "Fee": "1", "Reserves": reserves}


def test_a_tick_update_is_decimal_or_wide_or_rejected(spark):
    parsed = events.parsed_tick_updates(decoded(spark, update("7"), update("9" * 40), update("x"), update("")))
    seqs = lambda df: sorted(r["seq"] for r in df.collect())
    assert seqs(events.decimal_updates(parsed)) == [0, 3]
    assert seqs(events.wide_updates(parsed)) == [1]
    assert [r["reserves_text"] for r in events.rejected_updates(parsed).collect()] == ["x"]


def test_kinds_are_the_events_with_a_table_of_their_own(spark):
    foreign = update("7") | {"module": "bank"}
    found = decoded(spark, update("7"), foreign, {"type": "message", "module": "dex", "action": "Other"}, {"type": "message"})
    kinds = [r[0] for r in found.orderBy("seq").select(events.event_kind()).collect()]
    assert kinds == ["TickUpdate", "other", "other", "other"]


def test_tables_are_spread_over_a_number_of_tasks_that_spark_keeps(spark):
    rows = spark.range(100).select(F.col("id").alias("height"))
    text = plan(tables.spread_by_runs(rows, 10, 1, tasks=37))
    assert ", 37)" in text and "REPARTITION_BY_NUM" in text


def test_a_placed_log_has_more_tasks_when_it_has_more_records(spark, tmp_path, monkeypatch):
    from tests.test_events import event, tx
    from tidebook.schemas import TX_LOG

    rows = [tx(i, i, [event("message", action="x")]) for i in range(60)]
    log = spark.createDataFrame([tuple(r[f] for f in TX_LOG.names) for r in rows], TX_LOG)
    monkeypatch.setattr(placed, "RECORDS_PER_TASK", 5)
    asked = []
    whole = tables.spread_by_runs
    monkeypatch.setattr(placed, "spread_by_runs", lambda *a, tasks=None: asked.append(tasks) or whole(*a, tasks=tasks))
    placed.store_placed(log, str(tmp_path / "placed"), blocks=10)
    assert asked == [13] and placed.read_placed(spark, str(tmp_path / "placed"), blocks=10).count() == 60
