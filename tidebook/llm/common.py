"""What the operators of this subpackage share: reading, text batches, stored tables and connected components.

Every operator reads only the columns it names, so further columns of an input, also ones named like results, change
nothing. A null text counts as empty unless an operator says otherwise.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.session import configure, new_folder, stored

SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    fields: str,
    columns: tuple[str, ...] = ("doc_id", "text"),
) -> DataFrame:
    """One row per document from Python code that sees whole texts, a few hundred at a time.

    ``make()`` runs once per task and gives a function from a list of texts to the result columns in the order of
    ``fields``. The first of ``columns`` is the key, which is passed through, the last one the text.
    """
    narrow = docs.select(*[F.col(c) for c in columns])
    schema = T.StructType([narrow.schema[0], *T._parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = work([t if t is not None else "" for t in part.column(1).to_pylist()])
                key = part.column(0).cast(arrow.field(0).type)
                rest = [pa.array(c, type=f.type) for c, f in zip(made, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([key, *rest], schema=arrow)

    return narrow.mapInArrow(run, schema)


def sampled(rows: DataFrame, n: int, *columns: str, spare: float = 1.5) -> DataFrame:
    """At most ``n`` rows: the ones with the smallest hash of ``columns``.

    Rows whose hash is beyond the place where ``spare`` times ``n`` rows are expected are left out before anything is
    ordered. What tasks send then grows with ``n``, and not with ``n`` times the tasks. ``rows`` is counted first.
    """
    draw = F.shiftrightunsigned(F.xxhash64(*columns), 1)
    total = rows.count()
    near = rows if total <= spare * n else rows.where(draw < F.lit(int(spare * n / total * (1 << 63))))
    return near.orderBy(draw, *columns).limit(n)


_stored: list[tuple[SparkSession, str]] = []


def _remove_stored() -> None:
    for spark, path in _stored:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone, and with it the way to its folder
            return


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; it is removed when the driver ends."""
    if not _stored:
        atexit.register(_remove_stored)
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """The smallest id reachable from each id: ``id, component`` for the ids of ``edges(a, b)``.

    Every round takes the smallest label among the neighbours and the label of the own label, so the number of rounds
    is about the logarithm of the longest chain. Both are aggregates and equi-joins over ids; no group is collected.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).where("a <> b")
    both = keep(both.union(both.select("other", "id")).distinct(), "links")
    labels = keep(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        )
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        moved = labels.join(near, "id").join(far, "component").select(
            "id",
            F.least("component", "near", "far").alias("component"),
            (F.least("near", "far") < F.col("component")).alias("moved"),
        )
        moved = keep(moved, "labels")
        labels = moved.select("id", "component")
        if moved.where("moved").isEmpty():
            return labels


__all__ = ["components", "keep", "map_texts", "sampled", "stored", "table"]
