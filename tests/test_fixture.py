"""How the log of the checks is made of flat rows."""

from checks import fixture as fx
from tests.test_plans import plan
from tidebook.session import tasks_for

SF_DIR = "/root/testdata/sf0.001"


def test_the_log_is_grouped_flat_in_as_many_tasks_as_its_size_asks_for(spark, monkeypatch):
    monkeypatch.setattr(fx, "EVENTS_PER_TASK", 100)
    text = plan(fx.tx_log(spark, SF_DIR))
    moved = [line for line in text.splitlines() if "hashpartitioning(height" in line]
    # one shuffle, of flat columns, whose number of tasks Spark keeps; block times need no join
    assert len(moved) == 1 and ", 11)" in moved[0] and "REPARTITION_BY_NUM" in moved[0]
    assert "Join" not in text


def test_rows_of_a_task_stay_bounded(spark):
    assert tasks_for(spark, 0, 100) == 1
    for rows in (10**6, 10**7, 10**8):
        assert rows / tasks_for(spark, rows, 25_000) <= 25_000
