"""Ordering, top rows, pages and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators.ordered import number_rows

# Page size limits.
MAX_LIMIT = 10000
DEFAULT_LIMIT = 1000
FIRST_PAGE = 100


def order_by_time_desc(df: DataFrame) -> DataFrame:
    """Newest bucket first."""
    return df.orderBy(F.desc("time_unix"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page_limits(offset: int | None = None, limit: int | None = None, default: int = DEFAULT_LIMIT) -> tuple[int, int]:
    """Offset from 0 on, limit up to the maximum; zero or missing means the default."""
    return max(0, offset or 0), min(MAX_LIMIT, limit or default)


def paginate(
    df: DataFrame, order: list[Column], offset: int | None = None, limit: int | None = None, default: int = DEFAULT_LIMIT
) -> DataFrame:
    """One page of a result, always by the same plan: the leading ``offset + limit`` rows as a top-k.

    Columns that are not part of the order break ties, so that pages neither overlap nor skip rows; only rows that are
    equal in every column can change places. For all pages of a large result use ``pages``, which orders it once.
    """
    start, size = page_limits(offset, limit, default)
    ties = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.orderBy(*order, *ties).offset(start).limit(size)


def next_offset(total: int, offset: int | None = None, limit: int | None = None, default: int = DEFAULT_LIMIT) -> int | None:
    """Offset of the page after this one, None on the last page."""
    start, size = page_limits(offset, limit, default)
    return start + size if total > start + size else None


def page_totals(df: DataFrame, side: str | None = None) -> DataFrame:
    """Row count of a result. For a two-sided result the count per side and the greater of both."""
    if side is None:
        return df.agg(F.count(F.lit(1)).alias("total"))
    first = F.count(F.when(F.col(side) == 0, 1))
    second = F.count(F.when(F.col(side) == 1, 1))
    return df.agg(
        first.alias("total0"), second.alias("total1"), F.greatest(first, second).alias("total")
    )


def pages(df: DataFrame, order: list[Column], limit: int = MAX_LIMIT, height: int | None = None) -> DataFrame:
    """All pages at once: page number and label of each row.

    A label is ``height:start-end/total``, or only the height when everything fits one page.
    """
    numbered = number_rows(df, order, "row")
    total = numbered.agg(F.max("row").alias("total")).scalar()
    start = F.floor((F.col("row") - 1) / limit).cast("long") * limit
    labelled = numbered.withColumn("page", F.floor((F.col("row") - 1) / limit).cast("long")).withColumn(
        "_total", total
    )
    prefix = F.lit("" if height is None else str(height))
    span = F.concat(
        F.lit(":"),
        (start + 1).cast("string"),
        F.lit("-"),
        F.least(start + limit, F.col("_total")).cast("string"),
        F.lit("/"),
        F.col("_total").cast("string"),
    )
    return labelled.withColumn(
        "label", F.when(F.col("_total") > limit, F.concat(prefix, span)).otherwise(prefix)
    ).drop("_total")


def feed_pages(
    df: DataFrame,
    order: list[Column],
    height: int,
    from_height: int = 0,
    side: str | None = None,
    first: int = FIRST_PAGE,
    limit: int = MAX_LIMIT,
) -> DataFrame:
    """All frames of a feed at one height: ``page`` and ``label`` of each row.

    Without a known height all frames are small, so that a client sees something soon; a client that names the height it
    has gets large ones. With ``side`` both lists are cut at the same places, and the longer one counts as the total.
    """
    size = first if from_height <= 0 else limit
    if side is None:
        numbered = number_rows(df, order, "row")
    else:
        parts = [number_rows(df.where(F.col(side) == k), order, "row") for k in (0, 1)]
        numbered = parts[0].unionByName(parts[1])
    total = numbered.agg(F.max("row").alias("total")).scalar()
    page = F.floor((F.col("row") - 1) / size).cast("long")
    end = F.least((page + 1) * size, F.col("_total"))
    span = F.concat(F.lit(f"{height}:"), (page * size + 1).cast("string"), F.lit("-"), end.cast("string"), F.lit("/"), F.col("_total").cast("string"))
    labelled = numbered.withColumn("_total", total).withColumn("page", page)
    return labelled.withColumn("label", F.when(F.col("_total") > size, span).otherwise(F.lit(str(height)))).drop("_total")
