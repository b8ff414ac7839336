import pytest
from pyspark.sql import functions as F

from tidebook.operators import assets, changes, liquidity, ordered, paging
from tidebook.sources import reference_data, tables


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1, 251).select(F.col("id").alias("n"), (F.col("id") % 7).alias("k"))


def test_limits():
    assert paging.page_limits(None, None) == (0, 1000)
    assert paging.page_limits(-5, 20000) == (0, 10000)
    assert paging.page_limits(3, 0, 100) == (3, 100)
    assert paging.next_offset(50, 10, 25) == 35
    assert paging.next_offset(35, 10, 25) is None


def test_pages_cover_the_result(numbers):
    order = [F.asc("k"), F.desc("n")]
    seen = []
    for offset in range(0, 250, 100):
        page = paging.paginate(numbers, order, offset, 100)
        seen += [r["n"] for r in page.orderBy(*order).collect()]
    assert seen == [r["n"] for r in numbers.orderBy(*order).collect()]
    assert paging.paginate(numbers, order, 1000, 10).count() == 0


def test_pages_of_an_order_with_ties_cover_the_result(numbers):
    order = [F.asc("k")]
    seen = [r["n"] for offset in range(0, 250, 50) for r in paging.paginate(numbers.repartition(offset // 50 + 1), order, offset, 50).collect()]
    assert sorted(seen) == sorted(r["n"] for r in numbers.collect())


def test_feed_pages(spark, numbers):
    found = {r["n"]: r for r in paging.feed_pages(numbers, [F.asc("n")], 9).collect()}
    assert (found[1]["label"], found[100]["page"], found[101]["label"], found[250]["label"]) == ("9:1-100/250", 0, "9:101-200/250", "9:201-250/250")
    assert {r["label"] for r in paging.feed_pages(numbers, [F.asc("n")], 9, from_height=4).collect()} == {"9"}
    sides = spark.createDataFrame([(int(i >= 30), i) for i in range(180)], "side int, n int")
    found = {r["n"]: r for r in paging.feed_pages(sides, [F.asc("n")], 9, side="side").collect()}
    assert (found[0]["label"], found[29]["page"], found[30]["label"], found[130]["label"]) == ("9:1-100/150", 0, "9:1-100/150", "9:101-150/150")


def test_page_labels(numbers):
    rows = {r["n"]: r for r in paging.pages(numbers, [F.asc("n")], 100, 7).collect()}
    assert (rows[1]["label"], rows[1]["page"]) == ("7:1-100/250", 0)
    assert (rows[250]["label"], rows[250]["page"]) == ("7:201-250/250", 2)
    assert {r["label"] for r in paging.pages(numbers, [F.asc("n")], 1000, 7).collect()} == {"7"}


def test_number_rows_with_one_heavy_value(spark):
    # most rows share the leading sort value
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("v"), "id")
    rows = ordered.number_rows(df, [F.asc("v"), F.desc("id")]).collect()
    expected = sorted(((r["v"], -r["id"]) for r in rows))
    assert sorted(r["row_number"] for r in rows) == list(range(1, 1001))
    for r in rows:
        assert expected[r["row_number"] - 1] == (r["v"], -r["id"])


def test_page_totals(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "side int")
    assert tuple(paging.page_totals(df, "side").first()) == (2, 1, 2)
    assert tuple(paging.page_totals(df).first()) == (3,)


def test_rows_not_in_compares_nulls_and_rank(spark):
    schema = "rank long, token string, reserves double"
    now = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, "c", 2.0)], schema)
    before = spark.createDataFrame([(1, "a", None), (3, "b", 1.0), (3, "c", 2.0)], schema)
    assert [r["token"] for r in liquidity.rows_not_in(now, before).collect()] == ["b"]


def test_equal_values_are_ordered_by_token(spark):
    valued = spark.createDataFrame(
        [("B", "C", 1.0), ("A", "C", 1.0), ("A", "B", 0.0), ("Z", "Z", 9.0)], "token0 string, token1 string, value double"
    )
    ranked = {(r["token0"], r["token1"]): r["rank"] for r in liquidity.rank_pairs(valued).collect()}
    assert ranked == {("Z", "Z"): 1, ("A", "C"): 2, ("B", "C"): 3, ("A", "B"): 4}


def test_suppress_repeats(spark):
    rows = spark.createDataFrame(
        [("f", 1, "x"), ("f", 1, "y"), ("f", 2, "y"), ("f", 2, "x"), ("f", 4, "x"), ("f", 5, "x"), ("f", 6, "z")],
        "feed string, height long, value string",
    )
    due = spark.createDataFrame([("f", h) for h in range(1, 8)] + [("g", 1)], "feed string, height long")
    for span in (1, 100):
        found = {(r["feed"], r["height"]): r["kind"] for r in changes.suppress_repeats(rows, due, ["feed"], span).collect()}
        sent = sorted(h for (f, h), kind in found.items() if kind == "update")
        assert sent == [1, 4, 6]
        assert found[("f", 3)] == found[("g", 1)] == "heartbeat"


def test_response_rows(spark):
    df = spark.createDataFrame([(5, "a\"b", 1, None, 2.5)], "t long, name string, n int, missing int, x double")
    row = tables.to_response_rows(df, "t", ["name", "n", "missing", "x"]).first()
    assert row["row"] == '[5,["a\\"b",1,null,2.5]]'
    assert tables.response_shape("t", ["n"]) == ["t", ["n"]]


def test_browse(spark, numbers):
    found = tables.browse_tables({"b": numbers, "a": numbers}, {"a": "n", "b": "n"}, 3)
    assert list(found) == ["a", "b"]
    assert sorted(r["n"] for r in found["a"].collect()) == [248, 249, 250]
    assert tables.browse_tables({"a": numbers}, {"a": "n"}, None)["a"].count() == 250
    numbers.createOrReplaceTempView("numbers_view")
    assert tables.browse_catalog(spark, {"numbers_view": "n"}, 2)["numbers_view"].count() == 2


def test_prices_keep_the_last_known_value(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 1), ("a", None, 2), ("b", 1.0, 1), ("b", 3.0, 2), ("c", None, 1)],
        "price_id string, usd double, last_updated_at long",
    )
    found = {r["price_id"]: (r["usd"], r["last_updated_at"]) for r in reference_data.read_token_prices(rows).collect()}
    assert found == {"a": (1.0, 1), "b": (3.0, 2)}


def test_assets_first_list_wins(spark):
    schema = "base string, display string"
    dynamic = spark.createDataFrame([("a", "new")], schema)
    static = spark.createDataFrame([("a", "old"), ("b", "only")], schema)
    found = {r["base"]: r["display"] for r in reference_data.read_assets(dynamic, static).collect()}
    assert found == {"a": "new", "b": "only"}
    mapping = spark.createDataFrame([("dev", "b")], "denom string, real_denom string")
    tokens = spark.createDataFrame([("dev",), ("a",), ("none",)], "token string")
    listed = static.withColumn("priority", F.lit(0))
    matched = {r["token"]: r["base"] for r in assets.asset_match(tokens, listed, mapping).collect()}
    assert matched == {"dev": "b", "a": "a"}


def test_tick_liquidity_rejects_empty_ranges(spark):
    versions = spark.createDataFrame(
        [("A", "B", "A", 3, 1, 5, 1)], "token0 string, token1 string, token string, tick int, fee int, reserves int, height long"
    )
    with pytest.raises(ValueError):
        liquidity.tick_liquidity(versions, 4, 4)
    row = liquidity.pair_liquidity(versions, 0, 4).first()
    assert (row["side"], row["tick"], row["reserves"]) == (0, -3, 5.0)
