"""How rows of the checks arrive as a stream."""

from pyspark.sql import functions as F

from checks import streams


def test_parts_are_written_in_one_pass_and_appear_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "ARRIVAL_ROWS", 20)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    # nothing falls into some of the parts
    ids = spark.range(200).where((F.col("id") < 90) | (F.col("id") >= 130)).withColumnRenamed("id", "height")
    ids.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).mapInArrow(seen, "height long")
    sizes, newest = [], []
    for path in streams.arrivals(rows, str(tmp_path / "stream")):
        here = spark.read.parquet(path)
        sizes.append(here.count())
        newest.append(here.agg(F.max("height")).first()[0])
        assert here.where(F.col("height") <= newest[-1]).count() == sizes[-1]
    assert sizes[-1] == 160 and sizes == sorted(sizes) and len(set(sizes)) == len(sizes)
    assert newest == sorted(newest) and newest[-1] == 199
    # once for the bounds and once for all parts, however many these are
    assert len(sizes) > 4 and read.value == 2 * 160
    assert not list((tmp_path / "stream" / "all").glob("batch=*"))
