from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidebook import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def unix(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "time, resolution, offset, expected",
    [
        (unix(2024, 2, 29, 23, 59, 59), "day", 0, unix(2024, 2, 29)),
        (unix(2024, 3, 1), "month", 0, unix(2024, 3, 1)),
        (unix(2024, 2, 29, 12), "month", 0, unix(2024, 2, 1)),
        (unix(2024, 3, 1, 1), "month", 7200, unix(2024, 2, 1) + 7200),
        (unix(2024, 1, 1, 5, 0, 0), "hour", 0, unix(2024, 1, 1, 5)),
        (unix(2024, 1, 1, 5, 0, 0), "day", 6 * 3600, unix(2023, 12, 31) + 6 * 3600),
        (unix(2024, 1, 1, 5, 7, 9), "minute", 0, unix(2024, 1, 1, 5, 7)),
        (unix(2024, 1, 1, 5, 7, 9), "second", 0, unix(2024, 1, 1, 5, 7, 9)),
        (unix(2024, 1, 1, 5, 7, 9), "unknown", 0, unix(2024, 1, 1, 5, 7)),
        (-1, "day", 0, -86400),
    ],
)
def test_time_bucket(spark, time, resolution, offset, expected):
    assert one(spark, fn.time_bucket(F.lit(time), resolution, offset)) == expected


def test_time_bucket_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, fn.time_bucket(F.lit(unix(2024, 3, 1, 1)), "month")) == unix(2024, 3, 1)
        assert one(spark, fn.iso_to_unix(F.lit("2024-03-01T01:00:00Z"))) == unix(2024, 3, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1970-01-01T00:00:01.5Z", 2),
        ("1970-01-01T00:00:01.499999Z", 1),
        ("1970-01-01T00:00:01.4999999999Z", 1),
        ("1970-01-01T01:00:00+01:00", 0),
    ],
)
def test_iso_to_unix(spark, text, expected):
    assert one(spark, fn.iso_to_unix(F.lit(text))) == expected


def test_day_offset_and_floors(spark):
    t = unix(2024, 1, 5, 3, 4, 5)
    assert one(spark, fn.day_offset(t)) == 3 * 3600 + 4 * 60 + 5
    assert one(spark, fn.floor_to_minute(t)) == t - 5
    assert one(spark, fn.floor_to_day(t)) == unix(2024, 1, 5)


@pytest.mark.parametrize(
    "value, digits, expected",
    [(98765.4321, 3, 98800.0), (1.2345, 4, 1.235), (0.0, 3, 0.0), (12.0, 3, 12.0), (999.5, 3, 1000.0), (1e30, 4, 1e30)],
)
def test_round_significant(spark, value, digits, expected):
    assert one(spark, fn.round_significant(F.lit(value), digits)) == expected


def test_tick_to_price(spark):
    assert one(spark, fn.tick_to_price(F.lit(0))) == 1.0
    assert one(spark, fn.tick_to_price(F.lit(10), True)) == pytest.approx(1.0001**-10)


def test_amounts(spark):
    big = "9" * 38
    assert one(spark, fn.amount(F.lit(big))) == Decimal(big)
    assert one(spark, fn.amount(F.lit("1" + "0" * 38))) is None
    assert one(spark, fn.amount(F.lit("1.5"))) is None
    assert one(spark, fn.amount(F.lit(""))) is None
    difference = fn.amount_difference(fn.amount(F.lit(big)), fn.amount(F.lit("1")))
    assert one(spark, difference) == Decimal(int(big) - 1)
    assert one(spark, fn.amount_difference(fn.amount(F.lit("7")), F.lit(None))) == 7


def test_unit_price(spark):
    assert one(spark, fn.unit_price(F.lit(0), F.lit(6), F.lit(2.0))) == pytest.approx(2e-6)
    assert one(spark, fn.unit_price(F.lit(None), F.lit(None), F.lit(None))) == 0.0


@pytest.mark.parametrize(
    "action, named",
    [
        ("/a.b.MsgX", True),
        ("/a.MsgX", True),
        ("/MsgX", False),
        ("a.b.MsgX", False),
        ("/a.b.X", False),
        ("/a.Msg.b", False),
        ("", False),
        (None, False),
    ],
)
def test_message_action(spark, action, named):
    column = F.lit(action).cast("string")
    assert one(spark, fn.is_message_action(column)) is named
    assert one(spark, fn.message_type_name(column)) == (action[1:] if named else None)


def test_message_type_id(spark):
    assert one(spark, fn.message_type_id(F.lit("/neutron.dex.MsgPlaceLimitOrder"))) == 3
    assert one(spark, fn.message_type_id(F.lit("/other.MsgThing"))) is None


def test_denominations(spark):
    assert one(spark, fn.bridged_hash(F.lit("ibc/00fFaB"))) == "00fFaB"
    assert one(spark, fn.bridged_hash(F.lit("ibc/xyz"))) is None
    assert one(spark, fn.bridged_hash(F.lit("untrn"))) is None
    assert one(spark, fn.path_port(F.lit("transfer/channel-7"))) == "transfer"
    assert one(spark, fn.path_channel(F.lit("transfer/channel-7"))) == "channel-7"


def test_denom_exponent(spark):
    units = F.from_json(
        F.lit('[{"denom":"u","exponent":0},{"denom":"m","exponent":3,"aliases":["k"]},{"denom":"k","exponent":9}]'),
        "array<struct<denom:string,exponent:int,aliases:array<string>>>",
    )
    assert one(spark, fn.denom_exponent(units, F.lit("u"))) == 0
    assert one(spark, fn.denom_exponent(units, F.lit("k"))) == 3
    assert one(spark, fn.denom_exponent(units, F.lit("none"))) is None


def test_attributes(spark):
    listed = F.from_json(
        F.lit('[{"key":"a","value":"1"},{"key":"a","value":"2"},{"value":"3"},{"key":"b"}]'),
        "array<struct<key:string,value:string>>",
    )
    assert one(spark, fn.attributes_map(listed)) == {"a": "2", "": "3", "b": ""}
    assert one(spark, fn.attributes_json(fn.attributes_map(listed))) == '{"a":"2","":"3","b":""}'
    nothing = F.lit(None).cast("array<struct<key:string,value:string>>")
    assert one(spark, fn.attributes_map(nothing)) == {}


def test_pack_seq(spark):
    assert one(spark, fn.pack_seq(F.lit(2), F.lit(5000))) == 2 * 2**32 + 5000
    assert one(spark, fn.pack_seq(F.lit(2), F.lit(None).cast("int"))) is None
    with pytest.raises(Exception, match="packed range"):
        one(spark, fn.pack_seq(F.lit(2), F.lit(2**32)))
    with pytest.raises(Exception, match="packed range"):
        one(spark, fn.pack_seq(F.lit(2**31), F.lit(0)))


def test_rounding_keeps_missing_values(spark):
    assert one(spark, fn.round_significant(F.lit(None).cast("double"), 3)) is None
