import os

import pytest

from tidebook.sources import versions
from tidebook.sources.versions import Version, VersionTaken


def write(spark, folder, table, rows):
    commit = versions.new_commit()
    spark.createDataFrame(rows, "id long").write.parquet(versions.commit_folder(folder, table, commit))
    return commit


def ids(spark, folder, table="a"):
    version = versions.newest_version(spark, folder)
    return sorted(r["id"] for r in versions.read_commits(spark, folder, table, "id long", version.commits[table]).collect())


def test_a_version_shows_whole_commits_only(spark, tmp_path):
    folder = str(tmp_path)
    assert versions.newest_version(spark, folder) is None
    one = Version().following(write(spark, folder, "a", [(1,)]), ["a"], [], 7)
    versions.publish(spark, folder, one)
    assert versions.newest_version(spark, folder) == one and ids(spark, folder) == [1]
    opened = versions.read_commits(spark, folder, "a", "id long", one.commits["a"])
    left = write(spark, folder, "a", [(2,)])  # a write that ended before its version
    (tmp_path / versions.VERSIONS / ".half").write_text('{"number": 9, "comm')
    assert ids(spark, folder) == [1]
    two = one.following(write(spark, folder, "a", [(3,)]), ["a"], [], 8)
    versions.publish(spark, folder, two)
    assert ids(spark, folder) == [1, 3] and two.newest == 8
    assert [r["id"] for r in opened.collect()] == [1]
    with pytest.raises(VersionTaken):
        versions.publish(spark, folder, one.following(left, ["a"], [], 9))
    assert versions.newest_version(spark, folder) == two


def test_replaced_tables_and_vacuum(spark, tmp_path):
    folder = str(tmp_path)
    one = Version().following(write(spark, folder, "a", [(1,)]), ["a"], [], None)
    versions.publish(spark, folder, one)
    two = one.following(write(spark, folder, "a", [(2,)]), [], ["a"], None)
    versions.publish(spark, folder, two)
    three = two.following(write(spark, folder, "b", [(5,)]), ["b"], [], None)
    versions.publish(spark, folder, three)
    write(spark, folder, "b", [(6,)])
    assert versions.vacuum(spark, folder, versions=2) == 0  # all are young
    assert versions.vacuum(spark, folder, versions=2, older_than=-10) == 2
    assert ids(spark, folder) == [2] and ids(spark, folder, "b") == [5]
    assert len(os.listdir(tmp_path / "a")) == 1
    assert versions.vacuum(spark, str(tmp_path / "none")) == 0


def test_a_table_without_commits_is_empty(spark, tmp_path):
    assert versions.read_commits(spark, str(tmp_path), "a", "id long", []).count() == 0
