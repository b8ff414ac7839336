"""Order-dependent derivations that never put a whole key into one task.

A key may hold a large share of all rows, so a window over the key alone would be one huge task. Rows are cut
into chunks of ``span`` consecutive positions (block heights by default). Each chunk is summarised per key with
map-side partial aggregation, the summaries are chained over the chunks of a key, and the result enters the chunk
as one extra row in front of it. The full rows are shuffled once, by key and chunk; a window inside the chunk does
the rest. The result is exact, and the largest window is bounded by the events of ``span`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.session import cut

CHUNK = "chunk"
DEFAULT_SPAN = 256
# Chunk numbers stay below this power of two.
CHUNK_LEVELS = 32
_HEAD = "_head"


def chunk_number(position: Column, span: int) -> Column:
    return F.floor(position / F.lit(span)).cast("long")


def with_chunk(df: DataFrame, position: str = "height", span: int = DEFAULT_SPAN) -> DataFrame:
    return df.withColumn(CHUNK, chunk_number(F.col(position), span))


def _chained(tails: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Chunk summaries, with an optional summary of everything before the first chunk."""
    if carry is None:
        return tails
    names = [c for c in tails.columns if c != CHUNK]
    return tails.unionByName(carry.select(*names).withColumn(CHUNK, F.lit(-1).cast("long")))


def _before(keys: list[str]):
    return W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)


def _headed(rows: DataFrame, heads: DataFrame, carry: DataFrame | None) -> DataFrame:
    if carry is not None:  # what is carried stands in a chunk of its own, before all others
        heads = heads.where(F.col(CHUNK) >= 0)
    return rows.withColumn(_HEAD, F.lit(False)).unionByName(
        heads.withColumn(_HEAD, F.lit(True)), allowMissingColumns=True
    )


def _inside(keys: list[str], order: str):
    return W.partitionBy(*keys, CHUNK).orderBy(F.col(_HEAD).desc(), F.col(order).asc())


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    position: str = "height",
    span: int = DEFAULT_SPAN,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Add the value of the previous row of the same key; null on the first row.

    ``carry`` holds the keys and the last value before this input, for incremental runs. The result keeps the
    ``chunk`` column and the partitioning by key and chunk, which later steps reuse.
    """
    rows = with_chunk(df, position, span)
    tails = rows.groupBy(*keys, CHUNK).agg(F.max_by(value, order).alias(value))
    chained = _chained(tails, carry)
    heads = chained.select(
        *keys, CHUNK, F.lag(value).over(W.partitionBy(*keys).orderBy(CHUNK)).alias(value)
    ).where(F.col(value).isNotNull())
    return (
        _headed(rows, heads, carry)
        .withColumn(out, F.lag(value).over(_inside(keys, order)))
        .where(~F.col(_HEAD))
        .drop(_HEAD)
    )


def last_known(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, str],
    position: str = "height",
    span: int = DEFAULT_SPAN,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Fill each column with its last given value up to the row. The input is read twice.

    ``columns`` maps a value column to a boolean column that says where the value is given; a given null counts.
    ``carry`` has the keys, the value columns and the flag columns.
    """
    rows = with_chunk(df, position, span)
    summary = []
    for value, given in columns.items():
        summary.append(F.max_by(value, F.when(F.col(given), F.col(order))).alias(value))
        summary.append(F.max(given).alias(given))
    tails = rows.groupBy(*keys, CHUNK).agg(*summary)
    chained = _chained(tails, carry)
    given_value = {v: F.last(F.when(F.col(g), F.struct(v)), ignorenulls=True) for v, g in columns.items()}
    before = _before(keys)
    heads = chained.select(*keys, CHUNK, *[w.over(before).alias(f"_{v}") for v, w in given_value.items()]).select(
        *keys,
        CHUNK,
        *[F.col(f"_{v}")[v].alias(v) for v in columns],
        *[F.col(f"_{v}").isNotNull().alias(g) for v, g in columns.items()],
    )
    inside = _inside(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = _headed(rows, heads, carry).withColumns({f"_{v}": w.over(inside) for v, w in given_value.items()})
    return (
        filled.where(~F.col(_HEAD))
        .withColumns({v: F.col(f"_{v}")[v] for v in columns})
        .drop(_HEAD, CHUNK, *[f"_{v}" for v in columns])
    )


def next_known(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, str],
    position: str = "height",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Fill each column with its next given value from the row on: ``last_known`` from the other end."""
    turned = df.withColumns({"_turned": -F.col(order), "_position": -F.col(position)})
    return last_known(turned, keys, "_turned", columns, position="_position", span=span).drop("_turned", "_position")


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, str],
    position: str = "height",
    span: int = DEFAULT_SPAN,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Add running sums up to and including each row; ``sums`` maps a result to the column it adds up.

    The input is read twice: an expensive one should be stored before.

    ``carry`` has the keys and the summed columns, holding the totals before this input.
    """
    rows = with_chunk(df, position, span)
    sources = list(dict.fromkeys(sums.values()))
    kinds = {c: rows.schema[c].dataType for c in sources}
    tails = rows.groupBy(*keys, CHUNK).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sources])
    chained = _chained(tails, carry)
    heads = chained.select(
        *keys, CHUNK, *[F.sum(c).over(_before(keys)).cast(kinds[c]).alias(c) for c in sources]
    ).where(F.coalesce(*sources).isNotNull())
    inside = _inside(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = _headed(rows, heads, carry).withColumns(
        {f"_{out}": F.sum(source).over(inside).cast(kinds[source]) for out, source in sums.items()}
    )
    return (
        summed.where(~F.col(_HEAD))
        .withColumns({out: F.col(f"_{out}") for out in sums})
        .drop(_HEAD, CHUNK, *[f"_{out}" for out in sums])
    )


def number_rows(df: DataFrame, order: list[Column], out: str = "row_number") -> DataFrame:
    """Number all rows from 1 in a total order, without sorting them in one task.

    Rows are range-partitioned and sorted, written once (so that a lost executor cannot re-cut the ranges), and each
    range is shifted by the row count of the ranges before it. The offsets table has one row per partition.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_range = (1 << 33) - 1
    placed = cut(
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(in_range)))
    )
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(out, F.col("_before") + F.col("_place") + 1)
        .drop("_range", "_place", "_before")
    )
