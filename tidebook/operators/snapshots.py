"""State at the border of height folders, so that a request for "now" reads one snapshot and one folder.

A snapshot has one row per live key and folder, whatever the length of the history before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.sources.tables import RANGE, SPAN, without_folders


def snapshots(
    rows: DataFrame, keys: list[str], order: str, span: int, newest: int, after: int = -1, live: Column | None = None
) -> DataFrame:
    """The newest row of every key before each folder of ``span`` blocks, up to the folder of the height ``newest``.

    ``after`` is the last folder that has a snapshot already; ``rows`` then start from the state it was made of. Keys whose
    newest row is not ``live`` are left out. The folder is the column that stored tables are partitioned by.
    """
    values = [c for c in rows.columns if c not in (*keys, order)]
    folder = F.floor(F.col("height") / F.lit(span)).cast("long")
    last = rows.groupBy(*keys, folder.alias("_folder")).agg(F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values])
    # the rows of a key here are as many as the folders it changed in
    until = F.lead("_folder").over(W.partitionBy(*keys).orderBy("_folder"))
    limit = F.lit(newest // span).cast("long")
    first = F.greatest(F.col("_folder") + 1, F.lit(after + 1))
    held = last.withColumn("_until", F.least(F.coalesce(until, limit), limit)).where(first <= F.col("_until"))
    if live is not None:
        held = held.where(live)
    return held.select(*rows.columns, F.explode(F.sequence(first, F.col("_until"))).alias(RANGE))


def since_snapshot(rows: DataFrame, taken: DataFrame, newest: int, to_height: int, from_height: int = 0) -> DataFrame:
    """Rows from which the state at ``to_height`` and the changes after ``from_height`` follow: a snapshot and the folders
    after it. ``rows`` is a stored table with its folders, ``taken`` its snapshots, ``newest`` the newest stored height."""
    span = rows.schema[RANGE].metadata[SPAN]
    last = min(to_height, newest) // span
    first = min(from_height, newest) // span if from_height > 0 else last
    tail = rows.where((F.col(RANGE) >= min(first, last)) & (F.col(RANGE) <= last))
    start = taken.where(F.col(RANGE) == min(first, last))
    return without_folders(start).unionByName(without_folders(tail))
