"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.schemas import AMOUNT


def as_column(value: Column | int | float | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def round_significant(value: Column, digits: int) -> Column:
    """Round half up to a number of significant digits; a missing value stays missing."""
    number = value.cast("double")
    return F.when(number.isNotNull(), F.format_string(f"%.{digits - 1}e", number).cast("double"))


def tick_to_price(tick: Column, inverted: Column | bool = False) -> Column:
    """Price of a tick, ``1.0001 ^ tick``."""
    signed = F.when(as_column(inverted), -tick).otherwise(tick)
    return F.pow(F.lit(1.0001), signed.cast("double"))


def amount(text: Column) -> Column:
    """Exact integer amount; null when the text is no integer of at most 38 digits."""
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text)
    return whole.try_cast(AMOUNT)


def amount_difference(current: Column, previous: Column) -> Column:
    """Exact difference of two amounts; a missing previous amount counts as zero."""
    return (current - F.coalesce(previous, F.lit(0).cast(AMOUNT))).cast(AMOUNT)


def unit_price(denom_exponent: Column, display_exponent: Column, usd: Column) -> Column:
    """Price of one base unit from the price of one display unit; zero when anything is missing."""
    zero = F.lit(0)
    power = F.coalesce(denom_exponent, zero) - F.coalesce(display_exponent, zero)
    return F.pow(F.lit(10.0), power.cast("double")) * F.coalesce(usd, F.lit(0.0))
