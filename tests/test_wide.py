import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import wide


def numbers():
    r = random.Random(5)
    near = [s * (10**p + d) for p in (0, 26, 27, 28, 38, 53, 54, 55, 76, 80) for d in (-1, 0, 1) for s in (1, -1)]
    return [0, *near, 2**256 - 1, 10**81 - 1, 1 - 10**81, *[r.randrange(-(10**80), 10**80) for _ in range(40)]]


def test_texts_limbs_and_back(spark):
    given = [str(n) for n in numbers()]
    odd = ["+7", "-0", "000" + "9" * 81, "", "1.5", "1e3", " 1", "9" * 82, "--1", None]
    rows = spark.createDataFrame([(t,) for t in given + odd], "t string")
    found = [r[0] for r in rows.select(wide.wide_text(wide.wide_amount(F.col("t")))).collect()]
    assert found == given + ["7", "0", "9" * 81, None, None, None, None, None, None, None]


def test_differences_sums_and_signs(spark):
    every = numbers()
    pairs = list(zip(every, every[7:] + every[:7]))
    rows = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    rows = rows.select(wide.wide_amount(F.col("a")).alias("a"), wide.wide_amount(F.col("b")).alias("b"))
    one = rows.select(wide.wide_text(wide.wide_difference(F.col("a"), F.col("b"))), wide.is_positive(F.col("a")), F.col("a") == F.col("b"))
    assert [tuple(r) for r in one.collect()] == [(str(a - b), a > 0, a == b) for a, b in pairs if abs(a - b) < 10**90]
    apart = rows.select(*[c.alias(n) for n, c in wide.limb_columns(rows, "a").items()])
    summed = apart.agg(*[F.sum(c).alias(c) for c in apart.columns]).select(wide.wide_text(wide.from_limb_columns("a")))
    assert summed.first()[0] == str(sum(every))


def test_amounts_of_tables(spark):
    texts = ["5", str(10**37), str(10**45 + 3), "-" + str(10**60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(wide.wide_amount(F.col("t")).alias("v"))
    table = wide.shown(rows, "v")
    assert [tuple(map(str, r)) for r in table.collect()] == [
        ("5", "None"), (str(10**37), "None"), ("None", texts[2]), ("None", texts[3])
    ]
    back = wide.unshown(table, "v").select(wide.wide_text(F.col("v")))
    assert [r[0] for r in back.collect()] == texts
    assert [r[0] for r in table.select(wide.is_large(table, "v")).collect()] == [False, True, True, True]
    positive = table.where("v > 0 or v_wide not like '-%'")
    assert positive.agg(wide.total(positive, "v")).first()[0] == pytest.approx(5 + 10**37 + 10**45)
