"""Warehouse tables as Parquet, table browsing and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.sources.versions import read_commits

# Blocks per folder, and blocks whose rows go to one file.
RANGE_SPAN = 100000
FILE_SPAN = 2000
RANGE = "height_range"
RUN = "_run"
SPAN = "blocks_per_folder"


def spread_by_runs(
    df: DataFrame, span: int = RANGE_SPAN, file_span: int = FILE_SPAN, tasks: int | None = None
) -> DataFrame:
    """Rows with their folder and run of blocks, all of a run in one task.

    They are spread by runs of blocks, never by pair, so a hot pair does not make a hot file; unlike a range
    partitioning this needs no sampling pass over an input that may be expensive to compute. Without a number of tasks
    Spark merges them by the compressed size of the rows, which may be a small part of what they take when sorted.
    """
    folder = F.floor(F.col("height") / span).cast("long")
    run = F.floor(F.col("height") / file_span).cast("long")
    placed = df.withColumns({RANGE: folder, RUN: run})
    return placed.repartition(tasks, RANGE, RUN) if tasks else placed.repartition(RANGE, RUN)


def write_table(
    df: DataFrame,
    path: str,
    sort: list[str],
    span: int = RANGE_SPAN,
    file_span: int = FILE_SPAN,
    mode: str = "overwrite",
    tasks: int | None = None,
) -> None:
    """Write rows in folders of height ranges, sorted inside the files so that min/max statistics prune."""
    spread = spread_by_runs(df, span, file_span, tasks).drop(RUN)
    spread.sortWithinPartitions(RANGE, *sort).write.mode(mode).partitionBy(RANGE).parquet(path)


def write_folders(df: DataFrame, path: str, sort: list[str], mode: str = "overwrite") -> None:
    """Write rows that name their folder themselves; a folder is spread by its first sort columns, here pairs."""
    spread = F.pmod(F.xxhash64(*sort), F.lit(16))
    df.repartition(RANGE, spread).sortWithinPartitions(RANGE, *sort).write.mode(mode).partitionBy(RANGE).parquet(path)


def read_table(
    spark: SparkSession,
    path: str,
    schema: str,
    from_height: int = 0,
    to_height: int | None = None,
    span: int = RANGE_SPAN,
    commits: list[str] | None = None,
) -> DataFrame:
    """Read a written table, or some commits of it; a height range prunes folders first and then row groups.

    The folder number stays as a column that knows its span, so that ranges asked for later prune folders as well;
    ``without_folders`` takes it away.
    """
    if commits is None:
        df = spark.read.schema(f"{schema}, {RANGE} long").parquet(path)
    else:
        df = read_commits(spark, *path.rsplit("/", 1), f"{schema}, {RANGE} long", commits)
    df = df.withColumn(RANGE, F.col(RANGE).alias(RANGE, metadata={SPAN: span}))
    if from_height > 0:
        df = df.where((F.col(RANGE) >= from_height // span) & (F.col("height") > from_height))
    if to_height is not None:
        df = df.where((F.col(RANGE) <= to_height // span) & (F.col("height") <= to_height))
    return df


def in_folders(df: DataFrame, above: Column | int | None = None, upto: Column | int | None = None) -> DataFrame:
    """Only folders that can hold heights in ``(above, upto]``, without the folder column; other tables stay as they are.

    Numbers become literals; columns, as scalar subqueries, are known before files are listed.
    """
    if RANGE not in df.columns:
        return df
    span = df.schema[RANGE].metadata[SPAN]
    folder = lambda h: h // span if isinstance(h, int) else F.floor(h / F.lit(span)).cast("long")
    if above is not None:
        df = df.where(F.col(RANGE) >= folder(above))
    if upto is not None:
        df = df.where(F.col(RANGE) <= folder(upto))
    return df.drop(RANGE)


def without_folders(df: DataFrame) -> DataFrame:
    return df.drop(RANGE)


def browse_tables(tables: dict[str, DataFrame], order: dict[str, str], limit: int | None = 100) -> dict[str, DataFrame]:
    """Newest rows of every table; all rows when there is no limit."""
    found = {}
    for name in sorted(tables):
        newest = without_folders(tables[name]).orderBy(F.desc(order[name]))
        found[name] = newest.limit(limit) if limit else newest
    return found


def browse_catalog(spark: SparkSession, order: dict[str, str], limit: int | None = 100) -> dict[str, DataFrame]:
    """As ``browse_tables`` over the tables and views registered in the session."""
    names = [t.name for t in spark.catalog.listTables() if t.name in order]
    return browse_tables({name: spark.table(name) for name in names}, order, limit)


def _json(column: str) -> Column:
    """One value as JSON text: the content of a one-field object."""
    wrapped = F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"})
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def to_response_rows(df: DataFrame, lead: str, values: list[str]) -> DataFrame:
    """Rows as ``[lead,[values]]`` JSON text."""
    inner = F.concat_ws(",", *[_json(v) for v in values])
    return df.select(F.col(lead), F.concat(F.lit("["), _json(lead), F.lit(",["), inner, F.lit("]]")).alias("row"))


def response_shape(lead: str, values: list[str]) -> list:
    """Header that names the parts of a response row."""
    return [lead, list(values)]
