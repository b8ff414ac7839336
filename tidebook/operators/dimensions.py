"""Token and pair dictionaries, key lookups and time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.ordered import DEFAULT_SPAN, running_sum
from tidebook.schemas import SWAP_MESSAGE
from tidebook.session import cut

# Attributes that name a token, in the order in which an event introduces them.
TOKEN_ATTRIBUTES = ("TokenZero", "TokenOne", "TokenIn", "TokenOut", "Token")


def _token_slots(events: DataFrame) -> DataFrame:
    names = F.array(*[F.col("attributes")[a] for a in TOKEN_ATTRIBUTES])
    return events.select("seq", "height", F.posexplode(names).alias("slot", "token")).where(
        F.coalesce(F.col("token"), F.lit("")) != ""
    )


def distinct_tokens(events: DataFrame) -> DataFrame:
    """Distinct tokens over the token attributes of any event."""
    return _token_slots(events).select("token").distinct()


def number_by_first_seen(entries: DataFrame, order: str, span: int = DEFAULT_SPAN, after: Column | int = 0) -> DataFrame:
    """Dense ids in the order of first appearance; ``entries`` has ``order`` and the block ``height``.

    Entries, one row per key of a dictionary, are found once: numbering reads them twice and a dictionary is often joined
    more than once, which would scan all events each time.
    """
    counted = running_sum(
        cut(entries).withColumn("_one", F.lit(1).cast("long")), [], order, {"id": "_one"}, span=span
    )
    return counted.withColumn("id", F.col("id") + after).drop("_one")


def first_seen_tokens(events: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Token dictionary: ``id, token, first_seq``."""
    return _numbered_tokens(seen_tokens(events), span)


def seen_tokens(events: DataFrame) -> DataFrame:
    """``token, height`` and the first place of each token, the slot of the event included."""
    # wider than a sequence number, so that no height overflows
    place = F.col("seq").cast("decimal(20,0)") * 8 + F.col("slot").cast("decimal(2,0)")
    return (
        _token_slots(events)
        .groupBy("token")
        .agg(F.min(place.cast("decimal(24,0)")).alias("_order"), F.min("height").alias("height"))
    )


def _numbered_tokens(seen: DataFrame, span: int, after: Column | int = 0) -> DataFrame:
    return number_by_first_seen(seen, "_order", span, after).select(
        "id", "token", F.floor(F.col("_order") / 8).cast("long").alias("first_seq")
    )


def first_seen_pairs(events: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Pair dictionary: ``id, token0, token1, first_seq``; the first event of a pair fixes its token order."""
    return number_by_first_seen(seen_pairs(events), "first_seq", span).select("id", "token0", "token1", "first_seq")


def seen_pairs(events: DataFrame) -> DataFrame:
    """``token0, token1, height, first_seq`` of each pair, in the order of its first event."""
    token0, token1 = F.col("attributes")["TokenZero"], F.col("attributes")["TokenOne"]
    both = (F.coalesce(token0, F.lit("")) != "") & (F.coalesce(token1, F.lit("")) != "")
    # numbers first, so that the full input is reduced by hash aggregation; names only on what is left
    oriented = (
        events.where(both)
        .groupBy(token0.alias("token0"), token1.alias("token1"))
        .agg(F.min("seq").alias("first_seq"), F.min("height").alias("height"))
    )
    return oriented.groupBy(
        F.least("token0", "token1").alias("_low"), F.greatest("token0", "token1").alias("_high")
    ).agg(
        F.min_by("token0", "first_seq").alias("token0"),
        F.min_by("token1", "first_seq").alias("token1"),
        F.min("height").alias("height"),
        F.min("first_seq").alias("first_seq"),
    )


def new_tokens(events: DataFrame, known: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Dictionary entries of tokens that ``known`` lacks, with ids that go on after its greatest."""
    new = seen_tokens(events).join(known.select("token"), "token", "left_anti")
    return _numbered_tokens(new, span, _greatest_id(known))


def new_pairs(events: DataFrame, known: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """The same for pairs, which are known in either token order."""
    sides = known.select(F.least("token0", "token1").alias("_low"), F.greatest("token0", "token1").alias("_high"))
    new = seen_pairs(events).join(sides, ["_low", "_high"], "left_anti")
    numbered = number_by_first_seen(new, "first_seq", span, _greatest_id(known))
    return numbered.select("id", "token0", "token1", "first_seq")


def _greatest_id(known: DataFrame) -> Column:
    return known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()


def add_new_entries(known: DataFrame, seen: DataFrame, keys: list[str], span: int = DEFAULT_SPAN) -> DataFrame:
    """Insert-if-absent: ids of new dictionary entries go on after the greatest known id.

    ``seen`` has the keys, ``first_seq`` and ``height``.
    """
    new = seen.join(known.select(*keys), keys, "left_anti")
    numbered = number_by_first_seen(new, "first_seq", span, after=_greatest_id(known))
    return known.select("id", *keys).unionByName(numbered.select("id", *keys))


def resolve_keys(events: DataFrame, tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``pair_id`` (stored token order) and ``token_id`` of the token in; rows without a match are dropped."""
    return events.join(
        pairs.select(F.col("id").alias("pair_id"), "token0", "token1"), ["token0", "token1"]
    ).join(tokens.select(F.col("id").alias("token_id"), F.col("token").alias("token_in")), ["token_in"])


def resolve_pair_unsorted(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Match ``token_a, token_b`` with a stored pair in either order, as an equi-join on the sorted tokens."""
    return _pairs_either_order(asked, pairs, "inner")


def _pairs_either_order(asked: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    left = asked.withColumn("_low", F.least("token_a", "token_b")).withColumn(
        "_high", F.greatest("token_a", "token_b")
    )
    right = pairs.select(
        F.col("id").alias("pair_id"),
        "token0",
        "token1",
        F.least("token0", "token1").alias("_low"),
        F.greatest("token0", "token1").alias("_high"),
    )
    return left.join(right, ["_low", "_high"], how).drop("_low", "_high")


def pair_orientation(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``inverted``: whether (A, B) is stored as (B, A); null for an unknown pair."""
    return (
        _pairs_either_order(asked, pairs, "left")
        .withColumn(
            "inverted",
            F.when(F.col("token0") == F.col("token_a"), F.lit(False)).when(
                F.col("token0") == F.col("token_b"), F.lit(True)
            ),
        )
        .drop("pair_id", "token0", "token1")
    )


def join_event_time(series: DataFrame, block: DataFrame) -> DataFrame:
    """Add the block time to rows that carry their height; rows of unknown blocks are dropped."""
    return series.join(block.select("height", "time_unix"), "height")


def join_event_msg_time(updates: DataFrame, block: DataFrame, message: int = SWAP_MESSAGE) -> DataFrame:
    """Tick updates caused by one type of message, with block time."""
    return join_event_time(updates.where(F.col("msg_type") == message), block)


def join_pair_tokens(pairs: DataFrame, tokens: DataFrame, reserves: DataFrame) -> DataFrame:
    """Pairs by token id, both token names and the latest reserves."""
    first = tokens.select(F.col("id").alias("token0_id"), F.col("token").alias("token0"))
    second = tokens.select(F.col("id").alias("token1_id"), F.col("token").alias("token1"))
    return pairs.join(first, "token0_id").join(second, "token1_id").join(reserves, ["token0", "token1"])
