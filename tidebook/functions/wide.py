"""Exact integers beyond 38 digits, as three limbs of 27 decimal digits.

A number is ``a * 10**54 + b * 10**27 + c`` with ``b`` and ``c`` from 0 on and below ``10**27`` and the sign in ``a``, so equal
numbers have equal limbs. Limbs are 38-digit decimals: sums of up to ``10**11`` limbs are exact without a carry in between,
so they can be added up column by column, in partial aggregates and in windows, and are put in order at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.numbers import amount
from tidebook.schemas import AMOUNT

LIMBS = ("a", "b", "c")
DIGITS = 27
WIDE = T.StructType([T.StructField(name, AMOUNT) for name in LIMBS])
#: Amounts from this size on are counted in limbs, so that totals of smaller ones stay below 38 digits.
WIDE_FROM = 10**30


def _base() -> Column:
    return F.lit("1" + "0" * DIGITS).cast(AMOUNT)


def _limb(value: Column) -> Column:
    return value.cast(AMOUNT)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normal(a: Column, b: Column, c: Column) -> Column:
    """Limbs with the carry taken on, from sums or differences of limbs."""

    def parted(limb: Column) -> Column:
        carry = lambda v, rest: _limb(F.call_function("div", _limb(v - rest), _base()))  # noqa: E731  at most 11 digits
        both = lambda v: _bound(
            _limb(F.pmod(v, _base())), lambda rest: F.struct(rest.alias("rest"), carry(v, rest).alias("carry"))
        )
        return _bound(_limb(limb), both)

    def upper(v: Column) -> Column:
        middle = parted(v["b"] + v["low"]["carry"])
        limbs = lambda m: F.struct(
            _limb(v["a"] + m["carry"]).alias("a"), m["rest"].alias("b"), v["low"]["rest"].alias("c")
        )
        return _bound(middle, limbs)

    return _bound(F.struct(_limb(a).alias("a"), _limb(b).alias("b"), parted(c).alias("low")), upper)


def widened(value: Column) -> Column:
    """Limbs of a 38-digit amount; null stays null."""
    zero = F.lit(0).cast(AMOUNT)
    return F.when(value.isNotNull(), normal(zero, zero, value))


def wide_amount(text: Column) -> Column:
    """Limbs of an integer of at most 81 digits in text, else null."""
    digits = F.regexp_extract(text, r"^[+-]?0*([0-9]{1,81})$", 1)
    full = F.lpad(digits, 3 * DIGITS, "0")
    sign = F.when(text.startswith("-"), -1).otherwise(1).cast(AMOUNT)
    part = lambda i: _limb(sign * F.substring(full, 1 + i * DIGITS, DIGITS).try_cast(AMOUNT))
    return F.when(digits != "", normal(part(0), part(1), part(2)))


def wide_zero() -> Column:
    zero = F.lit(0).cast(AMOUNT)
    return F.struct(*[zero.alias(name) for name in LIMBS])


def wide_difference(current: Column, previous: Column) -> Column:
    """Exact difference; a missing previous number counts as zero."""
    known = F.coalesce(previous, wide_zero())
    return normal(*[current[name] - known[name] for name in LIMBS])


def is_positive(value: Column) -> Column:
    return (value["a"] > 0) | ((value["a"] == 0) & ((value["b"] > 0) | (value["c"] > 0)))


def wide_text(value: Column) -> Column:
    """The number as text without leading zeros."""

    def digits(size: Column) -> Column:
        padded = [F.lpad(size[name].cast("string"), DIGITS, "0") for name in LIMBS[1:]]
        return F.regexp_replace(F.concat(size["a"].cast("string"), *padded), r"^0+(?=.)", "")

    def text(v: Column) -> Column:
        minus = F.concat(F.lit("-"), _bound(normal(*[-v[name] for name in LIMBS]), digits))
        return F.when(v["a"] < 0, minus).when(v.isNotNull(), digits(v))

    return _bound(value, text)


def beyond(text: Column) -> Column:
    """The text of an integer that is too long for an amount, else null."""
    return F.when(amount(text).isNull(), wide_text(wide_amount(text)))


def is_wide(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StructType)


def limb_columns(df: DataFrame, column: str) -> dict[str, Column]:
    """One column per limb, to add up; ``from_limb_columns`` puts their sums in order."""
    return {f"{column}_{name}": F.col(column)[name] for name in LIMBS}


def from_limb_columns(column: str) -> Column:
    return normal(*[F.col(f"{column}_{name}") for name in LIMBS])


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Amounts as tables hold them: the amount where it has at most 38 digits, else its text in ``<column>_wide``."""
    for column in columns:
        if is_wide(df, column):
            text = wide_text(F.col(column))
            df = df.withColumn(f"{column}_wide", F.when(amount(text).isNull(), text)).withColumn(column, amount(text))
        else:
            df = df.withColumn(f"{column}_wide", F.lit(None).cast("string"))
    return df


def unshown(df: DataFrame, *columns: str) -> DataFrame:
    """The limbs of such amounts."""
    for column in columns:
        limbs = F.coalesce(wide_amount(F.col(f"{column}_wide")), widened(F.col(column)))
        df = df.withColumn(column, limbs).drop(f"{column}_wide")
    return df


def is_large(df: DataFrame, column: str) -> Column:
    """Whether an amount of a table is to be counted in limbs."""
    large = F.abs(F.col(column)) >= F.lit(str(WIDE_FROM)).cast(AMOUNT)
    large = F.coalesce(large, F.lit(False))
    return large | F.col(f"{column}_wide").isNotNull() if f"{column}_wide" in df.columns else large


def total(df: DataFrame, column: str) -> Column:
    """Sum of the amounts of a table as a floating point number: exact sums of the usual ones, plus the large ones."""
    if f"{column}_wide" not in df.columns:
        return F.sum(column).cast("double")
    large = is_large(df, column)
    number = F.coalesce(F.col(column).cast("double"), F.col(f"{column}_wide").cast("double"))
    usual = F.coalesce(F.sum(F.when(~large, F.col(column))).cast("double"), F.lit(0.0))
    return usual + F.coalesce(F.sum(F.when(large, number)), F.lit(0.0))
