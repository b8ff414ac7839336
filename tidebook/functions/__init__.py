"""Column functions. Each takes and returns a Column and stays inside the JVM."""

from tidebook.functions.numbers import (
    amount,
    amount_difference,
    as_column,
    round_significant,
    tick_to_price,
    unit_price,
)
from tidebook.functions.text import (
    attributes_json,
    attributes_map,
    bridged_hash,
    denom_exponent,
    is_message_action,
    message_type_id,
    message_type_name,
    pack_seq,
    path_channel,
    path_port,
)
from tidebook.functions.time import (
    RESOLUTIONS,
    day_offset,
    floor_to_day,
    floor_to_minute,
    iso_to_unix,
    time_bucket,
)

__all__ = [
    "RESOLUTIONS",
    "amount",
    "amount_difference",
    "as_column",
    "attributes_json",
    "attributes_map",
    "bridged_hash",
    "day_offset",
    "denom_exponent",
    "floor_to_day",
    "floor_to_minute",
    "is_message_action",
    "iso_to_unix",
    "message_type_id",
    "message_type_name",
    "pack_seq",
    "path_channel",
    "path_port",
    "round_significant",
    "tick_to_price",
    "time_bucket",
    "unit_price",
]
