"""Text, attribute and key functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.schemas import MESSAGE_TYPES, PLACE_BITS

# Fixed value: denomination of a bridged token.
BRIDGED_DENOM = r"^ibc/([0-9A-Fa-f]+)$"


def bridged_hash(denom: Column) -> Column:
    """Hash of a bridged denomination, null for a native one."""
    found = F.regexp_extract(denom, BRIDGED_DENOM, 1)
    return F.when(found != "", found)


def path_port(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def path_channel(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(2))


def is_message_action(action: Column) -> Column:
    """Whether an action names a message: a leading slash, two or more dotted parts, the last starting with Msg."""
    parts = F.split(F.substr(action, F.lit(2)), r"\.")
    named = action.startswith("/") & (F.size(parts) > 1) & F.element_at(parts, -1).startswith("Msg")
    return F.coalesce(named, F.lit(False))


def message_type_name(action: Column) -> Column:
    """Dotted name behind the leading slash of a message action."""
    return F.when(is_message_action(action), F.substr(action, F.lit(2)))


def message_type_id(action: Column) -> Column:
    """Enumeration id of a message action, null when it is unknown."""
    name = message_type_name(action)
    found = F.lit(None).cast("int")
    for known, number in MESSAGE_TYPES.items():
        found = F.when(name == known, F.lit(number)).otherwise(found)
    return found


def attributes_map(attributes: Column) -> Column:
    """Attribute list as a map. Missing keys and values become empty text; the last of equal keys wins."""
    return F.map_from_entries(
        F.transform(
            F.coalesce(attributes, F.array().cast("array<struct<key:string,value:string>>")),
            lambda a: F.struct(
                F.coalesce(a["key"], F.lit("")).alias("key"), F.coalesce(a["value"], F.lit("")).alias("value")
            ),
        )
    )


def attributes_json(attributes: Column) -> Column:
    """Attribute map as JSON text."""
    return F.to_json(attributes)


def denom_exponent(denom_units: Column, denom: Column) -> Column:
    """Exponent of the first unit whose name or aliases hold the denomination."""
    matching = F.filter(
        denom_units,
        lambda u: (u["denom"] == denom) | F.coalesce(F.array_contains(u["aliases"], denom), F.lit(False)),
    )
    return F.get(matching, F.lit(0))["exponent"]


def pack_seq(height: Column, place: Column) -> Column:
    """One sortable number for an event: its height and its place among the events of the block, from 0.

    A height of 31 bits and four billion events a block fit; anything beyond fails instead of colliding.
    """
    within = (height < F.lit(1 << 31)) & (place < F.lit(1 << PLACE_BITS))
    packed = F.shiftleft(height.cast("long"), PLACE_BITS) + place.cast("long")
    exceeded = F.raise_error(F.lit("height or event count of a block exceeds the packed range")).cast("long")
    # a missing place gives no number
    return F.when(within, packed).when(~within, exceeded)
