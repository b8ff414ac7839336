"""Versions of a stored set of tables, so that a change of several tables appears at once or not at all.

Every write of tables gets a commit of its own: new folders ``<table>/commit=<id>`` that nobody reads yet. A version is one
small file that lists the commits of each table; it is written aside and put in its place by a rename that never replaces a
file. Readers take the newest version and see its commits only, so they keep what they opened while others write, and what
an interrupted write left is never read. Two writers that start from the same version cannot both put the next in place:
the second one fails and starts again.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

VERSIONS = "_versions"
COMMIT = "commit"


class VersionTaken(RuntimeError):
    """Another writer has put the version in place first; nothing of this write is visible."""


@dataclass(frozen=True)
class Version:
    """Commits per table, and what readers and the next writer need to know without reading a table."""

    number: int = 0
    newest: int | None = None
    blocks: int | None = None
    commits: dict[str, list[str]] = field(default_factory=dict)

    def following(self, commit: str, added: list[str], replaced: list[str], newest: int | None) -> Version:
        """The next version: ``commit`` adds to some tables and is all of others."""
        commits = dict(self.commits)
        commits |= {name: [*commits.get(name, []), commit] for name in added}
        commits |= {name: [commit] for name in replaced}
        return replace(self, number=self.number + 1, newest=newest, commits=commits)


def _hadoop(spark: SparkSession, folder: str):
    fs = spark._jvm.org.apache.hadoop.fs
    path = fs.Path(folder)
    return fs, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_commit() -> str:
    return uuid.uuid4().hex


def commit_folder(folder: str, table: str, commit: str) -> str:
    return f"{folder}/{table}/{COMMIT}={commit}"


def newest_version(spark: SparkSession, folder: str) -> Version | None:
    """The newest version of a folder, or None where nothing has been stored."""
    fs, path, files = _hadoop(spark, f"{folder}/{VERSIONS}")
    if not files.exists(path):
        return None
    names = [f.getPath().getName() for f in files.listStatus(path)]
    numbers = [int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{12}\.json", n)]
    if not numbers:
        return None
    stream = files.open(fs.Path(f"{folder}/{VERSIONS}/{max(numbers):012d}.json"))
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, version: Version) -> None:
    """Put a version in place, or raise ``VersionTaken`` when its number is there already."""
    fs, aside, files = _hadoop(spark, f"{folder}/{VERSIONS}/.{uuid.uuid4().hex}")
    place = fs.Path(f"{folder}/{VERSIONS}/{version.number:012d}.json")
    out = files.create(aside, False)
    try:
        out.write(bytearray(json.dumps(asdict(version), indent=1).encode()))
    finally:
        out.close()
    if not rename_once(spark, aside, place):
        files.delete(aside, False)
        raise VersionTaken(f"version {version.number} of {folder} is there already")


def rename_once(spark: SparkSession, source, target) -> bool:
    """Move a file or folder in one step; False, and nothing moved, where the target is there already."""
    fs, _, files = _hadoop(spark, target.toString())
    context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(source), files.makeQualified(target), no_overwrite)
    except Exception:
        if files.exists(target):
            return False
        raise
    return True


def read_commits(spark: SparkSession, folder: str, table: str, schema: str, commits: list[str]) -> DataFrame:
    """The rows of some commits of a table; partition columns below the commits can be part of the schema."""
    if not commits:
        return spark.createDataFrame([], schema)
    paths = [commit_folder(folder, table, c) for c in commits]
    reader = spark.read.schema(f"{schema}, {COMMIT} string").option("basePath", f"{folder}/{table}")
    return reader.parquet(*paths).drop(COMMIT)


def vacuum(spark: SparkSession, folder: str, versions: int = 2, older_than: float = 7 * 86400.0) -> int:
    """Delete the commits that none of the newest ``versions`` lists and that are older than so many seconds; their number.

    Younger ones may belong to a write that still runs, and readers may still have an older version open.
    """
    fs, path, files = _hadoop(spark, f"{folder}/{VERSIONS}")
    newest = newest_version(spark, folder)
    if newest is None:
        return 0
    used: set[tuple[str, str]] = set()
    for number in range(max(1, newest.number - versions + 1), newest.number + 1):
        place = fs.Path(f"{folder}/{VERSIONS}/{number:012d}.json")
        if files.exists(place):
            stream = files.open(place)
            listed = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["commits"]
            stream.close()
            used |= {(table, commit) for table, commits in listed.items() for commit in commits}
    removed = 0
    for found in files.globStatus(fs.Path(f"{folder}/*/{COMMIT}=*")) or []:
        where = found.getPath()
        key = (where.getParent().getName(), where.getName().split("=", 1)[1])
        if key not in used and found.getModificationTime() < 1000 * (time.time() - older_than):
            files.delete(where, True)
            removed += 1
    return removed
