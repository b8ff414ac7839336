import pytest

from tidebook.operators import ranges

BLOCKS = [(10, 1000), (12, 1060), (15, 1060), (20, 4000)]


@pytest.fixture(scope="module")
def block(spark):
    return spark.createDataFrame(BLOCKS, "height long, time_unix long")


def value(df):
    return df.first()[0]


@pytest.mark.parametrize("height, expected", [(0, 0), (9, 0), (10, 1000), (14, 1060), (99, 4000)])
def test_time_at_or_before(block, height, expected):
    assert value(ranges.time_at_or_before_height(block, height)) == expected


@pytest.mark.parametrize("height, expected", [(0, 1000), (10, 1060), (19, 4000), (20, 4001), (99, 4001)])
def test_time_after(block, height, expected):
    assert value(ranges.time_after_height(block, height)) == expected


def test_time_after_without_blocks(spark, block):
    empty = block.where("false")
    assert value(ranges.time_after_height(empty, 0)) == 0
    assert value(ranges.time_at_or_before_height(empty, 5)) == 0


@pytest.mark.parametrize("time, expected", [(999, 0), (1000, 10), (1060, 15), (10**6, 20)])
def test_height_at_time(block, time, expected):
    assert value(ranges.height_at_time(block, time)) == expected
    assert value(ranges.completed_height_at_time(block, time, 15)) == min(expected, 15)


def test_bulk_lookups_equal_single_ones(spark, block):
    asked = spark.createDataFrame([(t,) for t in (0, 999, 1000, 1059, 1060, 1061, 5000, 5000)], "time_unix long")
    for span in (7, 1000):
        rows = ranges.height_at_time_bulk(asked, block, span).collect()
        assert len(rows) == 8
        for row in rows:
            assert row["height"] == value(ranges.height_at_time(block, row["time_unix"]))
    heights = spark.createDataFrame([(h,) for h in (0, 10, 11, 12, 19, 20, 50)], "height long")
    for row in ranges.time_at_height_bulk(heights, block, 3).collect():
        assert row["time_unix"] == value(ranges.time_at_or_before_height(block, row["height"]))


def test_bulk_lookups_after_a_height_equal_single_ones(spark, block):
    asked = [-3, 0, 9, 10, 11, 12, 14, 15, 19, 20, 21, 50, 50, 10**12]
    heights = spark.createDataFrame([(h, i) for i, h in enumerate(asked)], "height long, row int")
    for span in (1, 3, 4096):
        rows = ranges.time_after_height_bulk(heights, block, span).collect()
        assert sorted(r["row"] for r in rows) == list(range(len(asked)))
        for row in rows:
            assert row["time_unix"] == value(ranges.time_after_height(block, row["height"]))
    assert {r["time_unix"] for r in ranges.time_after_height_bulk(heights, block.where("false")).collect()} == {0}
    missing = spark.createDataFrame([(None, 1), (12, 2)], "height long, row int")
    assert sorted((r["row"], r["time_unix"]) for r in ranges.time_after_height_bulk(missing, block).collect()) == [(1, None), (2, 1060)]
    assert ranges.time_after_height_bulk(heights.where("false"), block).count() == 0


def test_completed_heights_in_bulk_equal_single_ones(spark, block):
    asked = spark.createDataFrame([(t,) for t in (0, 999, 1000, 1060, 4000, 5000, 5000)], "time_unix long")
    rows = ranges.completed_height_at_time_bulk(asked, block, 15).collect()
    assert len(rows) == 7
    for row in rows:
        assert row["height"] == value(ranges.completed_height_at_time(block, row["time_unix"], 15))


def test_last_and_completed(block):
    assert tuple(ranges.last_block(block).first()) == (20, 4000)
    assert value(ranges.last_completed_height(block)) == 15
    assert value(ranges.last_completed_height(block, end_of_input=True)) == 20
    assert ranges.completed_blocks(block).count() == 3


def test_block_range(block):
    assert [r["height"] for r in ranges.block_range(block, 10, 15).orderBy("height").collect()] == [12, 15]
    assert ranges.block_range(block, 0, 0).count() == 4
    assert ranges.block_range(block, -3, -1, last_completed=15).count() == 3


def test_time_range_prefers_heights(block):
    rows = ranges.time_range(block, block, 20, after=1000, before=1060)
    assert sorted(r["height"] for r in rows.collect()) == [12, 15]
    rows = ranges.time_range(block, block, 15, after=1000, from_height=12)
    assert [r["height"] for r in rows.collect()] == [15]
    # never past the last completed block
    assert ranges.time_range(block, block, 12, to_height=99).count() == 2


def test_range_checks(block):
    assert ranges.within_bounds(block, block, 12, 12, "minute").count() == 0
    with pytest.raises(ValueError):
        ranges.within_bounds(block, block, 15, 12, "minute")
    with pytest.raises(ValueError):
        ranges.check_range(5, 5, allow_equal=False)
    # past the last block: the bound is one second later than it, so nothing is left
    assert ranges.within_bounds(block, block, 50, 60, "second").count() == 0


def test_bounds_are_floored_without_the_offset(block):
    low, high = ranges.aligned_time_bounds(block, 10, 20, "hour", 500)
    assert (value(low), value(high)) == (0, 4000)
    low, _ = ranges.aligned_time_bounds(block, 10, 20, "hour", 500, align_bounds_to_offset=True)
    assert value(low) == 500
