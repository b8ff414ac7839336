"""Keyed state between micro-batches, as Parquet in the shared folder.

Each batch writes its changed keys under its own batch number, and every few batches the whole state is written
once. A batch reads only the last whole state and the changes after it. Paths depend on the batch number alone, so
a batch that is run again after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.session import no_rows, remove
from tidebook.sources.versions import rename_once

_BATCH = "_batch"


class StateTable:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str, compact_every: int = 20):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.keys = keys
        self.schema = T.StructType.fromDDL(f"{schema}, {_BATCH} long")
        self.values = [n for n in self.schema.names if n not in (*keys, _BATCH)]
        self.compact_every = compact_every

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}-{batch:012d}"

    def before(self, batch: int) -> DataFrame:
        """Newest row of every key from the batches before ``batch``."""
        whole = (batch - 1) // self.compact_every * self.compact_every if batch > 0 else 0
        paths = [self._path("changed", b) for b in range(whole + 1 if whole else 0, batch)]
        if whole:
            paths.append(self._path("whole", whole))
        if not paths:
            return no_rows(self.spark, self.schema).drop(_BATCH)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return self._newest(rows).drop(_BATCH)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(
            *[F.max_by(v, _BATCH).alias(v) for v in self.values], F.max(_BATCH).alias(_BATCH)
        )

    def write(self, batch: int, changed: DataFrame) -> None:
        """Store the changed keys of a batch, one row per key."""
        rows = changed.select(*self.keys, *self.values).withColumn(_BATCH, F.lit(batch).cast("long"))
        rows.write.mode("overwrite").parquet(self._path("changed", batch))
        if batch > 0 and batch % self.compact_every == 0:
            self.before_and(batch).write.mode("overwrite").parquet(self._path("whole", batch))

    def before_and(self, batch: int) -> DataFrame:
        """State after ``batch``, which must have been written."""
        own = self.spark.read.schema(self.schema).parquet(self._path("changed", batch))
        earlier = self.before(batch).withColumn(_BATCH, F.lit(batch - 1).cast("long"))
        return self._newest(own.unionByName(earlier))


class BatchOutput:
    """Rows produced per batch, one folder per batch number.

    A folder is written aside and appears whole by one rename, which never replaces another: whoever follows the folder
    as a stream sees all files of a batch or none, and a batch that runs again gives back what it wrote before, under the
    same file names, so that nothing downstream takes it for new rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def write(self, batch: int, rows: DataFrame) -> DataFrame:
        """Write the rows of a batch and return them as stored, so that nothing computes them again."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        place = fs.Path(f"{self.folder}/batch={batch}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            aside = f"{self.folder}.aside/{uuid.uuid4().hex}"
            rows.write.parquet(aside)
            files.mkdirs(fs.Path(self.folder))
            if not rename_once(self.spark, fs.Path(aside), place):
                remove(self.spark, aside)
        return self.of(batch, rows.schema)

    def of(self, batch: int, schema: T.StructType | str | None = None) -> DataFrame:
        """The stored rows of one batch."""
        return self.spark.read.schema(schema or self.schema).parquet(f"{self.folder}/batch={batch}")

    def remove(self, batch: int) -> None:
        """Delete the rows of a batch that nobody needs any more."""
        remove(self.spark, f"{self.folder}/batch={batch}")

    def read(self) -> DataFrame:
        """All rows written so far, with their ``batch``."""
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(self.folder)
