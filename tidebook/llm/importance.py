"""Selection of documents that look like a target: importance weights from hashed n-gram models, Gumbel top-k."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.common import SLICE_ROWS, keep, map_texts

#: Words and pairs of words fall into so many buckets; the two models are a count per bucket, whatever the corpus.
BUCKETS = 1 << 16
#: What a document keeps of its log-ratio unless the caller asks for the sum: the mean per n-gram times this, so that length
#: alone decides nothing. On held-out labels the sum selects worse among short texts (figures in the README).
SHARPNESS = 240.0
SEED = 17


def text_buckets(text: str) -> np.ndarray:
    """Buckets of all words (with A-Z in lower case), pairs of neighbouring words, and shapes of words."""
    raw = text.encode("utf-8", "surrogatepass")
    shapes = raw.translate(_SHAPES).split()
    words = raw.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    s = np.fromiter(map(xxhash.xxh3_64_intdigest, shapes), dtype=np.uint64, count=len(shapes)) * _ODD[0]
    pairs = (h[:-1] * _ODD[1] + h[1:]) * _ODD[2]
    return (np.concatenate([h * _ODD[3], pairs, s]) >> np.uint64(48)).astype(np.int64)


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``bucket, target, raw``: n-grams per bucket in all documents and in those with ``is_target``.

    Every task adds up its documents in two arrays of ``BUCKETS`` numbers and sends them once, so what is shuffled grows
    with the number of tasks and not with the number of n-grams.
    """
    schema = T._parse_datatype_string("bucket int, target long, raw long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                wanted, other = [], []
                for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (wanted if good else other).append(text_buckets(text or ""))
                if wanted:
                    counted = np.bincount(np.concatenate(wanted), minlength=BUCKETS)
                    target += counted
                    raw += counted
                if other:
                    raw += np.bincount(np.concatenate(other), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        columns = [pa.array(used, type=pa.int32()), pa.array(target[used]), pa.array(raw[used])]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    counts = docs.select("text", "is_target").mapInArrow(run, schema)
    return counts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


@dataclass
class Ratio:
    """Log-ratio of the two smoothed models per bucket."""

    values: np.ndarray

    def log_weight(self, text: str, sharpness: float | None = SHARPNESS) -> float:
        """``sharpness`` times the mean log-ratio of a text's n-grams, or their sum, the log-ratio of the two models for the
        whole text, where it is None; 0 for a text without words."""
        found = self.values[text_buckets(text)]
        if sharpness is None or not len(found):
            return float(found.sum())
        return float(found.mean()) * sharpness


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ratio:
    """Models of all documents labelled 1 and of all documents.

    Of several labels of a document the lowest counts; null labels and ids are no labels. Without any target document
    the ratio is 1 everywhere. Texts are joined with the marks by a hash of the id, at every size, so that what is sent
    to all tasks doesn't grow with the labels; texts without an id stay where they are.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("good")).where("good = 1")
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    marked = named.select("text", F.col("good").isNotNull().alias("is_target"))
    unnamed = docs.where(F.col("doc_id").isNull()).select("text", F.lit(False).alias("is_target"))
    marked = marked.union(unnamed)
    found = bucket_counts(marked).toPandas()  # at most one row per bucket
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[found["bucket"]], raw[found["bucket"]] = found["target"], found["raw"]
    if not target.sum():
        return Ratio(np.zeros(BUCKETS))
    smooth = 0.5
    return Ratio(np.log((target + smooth) / (target.sum() + smooth * BUCKETS)) - np.log((raw + smooth) / (raw.sum() + smooth * BUCKETS)))


def weighed(docs: DataFrame, ratio: Ratio, seed: int = SEED, sharpness: float | None = SHARPNESS) -> DataFrame:
    """``doc_id, log_weight, draw``: the importance weight of every whole text (see ``Ratio``), and with Gumbel noise added.

    The noise comes from a hash of the document's id, or of its text where that is null, so a run can be repeated and
    equal rows draw the same. A null or empty text has weight 0.
    """
    salted = docs.select(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text"))).alias("u"), "doc_id", "text")
    packed = salted.select(F.struct("doc_id", "u").alias("key"), "text")
    weights = lambda texts: [[ratio.log_weight(t, sharpness) for t in texts]]
    found = map_texts(packed, lambda: weights, "log_weight double", ("key", "text"))
    uniform = (F.shiftrightunsigned("key.u", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return found.select("key.doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("draw"))


def largest(rows: DataFrame, k: int, bins: int = 4096, bound: int = 10_000) -> tuple[float, int]:
    """``(value, ties)``: the k largest ``draw`` are those above ``value`` and ``ties`` of those equal to it.

    A histogram of the range that holds the k-th value is refined until few rows or a single value are left in a bin:
    every pass is one aggregation with a partial result per task, and no rows are sorted or collected beyond ``bound``.
    """
    low, high, n = rows.agg(F.min("draw"), F.max("draw"), F.count("draw")).first()
    if not n or k >= n:
        return -math.inf, 0
    if k <= 0:
        return math.inf, 0
    todo = k
    while True:
        inside = rows.where((F.col("draw") >= low) & (F.col("draw") <= high))
        if low == high or inside.count() <= bound:
            values = sorted((r[0] for r in inside.select("draw").limit(bound).collect()), reverse=True) if low < high else []
            if not values:
                return low, todo
            value = values[todo - 1]
            return value, todo - sum(v > value for v in values)
        width = (high - low) / bins
        place = F.least(F.floor((F.col("draw") - low) / width), F.lit(bins - 1)).alias("bin")
        found = inside.groupBy(place).agg(F.count("*").alias("n"), F.min("draw").alias("low"), F.max("draw").alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["low"]):
            if todo <= r["n"]:
                low, high = r["low"], r["high"]
                break
            todo -= r["n"]


def target_share(labels: DataFrame, label: str = "quality") -> float:
    """Share of the labelled documents that are targets; all where nothing is labelled."""
    least = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("good"))
    share = least.agg(F.avg((F.col("good") == 1).cast("double"))).first()[0]
    return 1.0 if share is None else share


def selected(
    docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, sharpness: float | None = SHARPNESS
) -> DataFrame:
    """``doc_id, log_weight, draw, kept``: a sample without replacement of ``share`` of the rows, by importance weight;
    by default the share of targets among the labelled documents.

    Adding Gumbel noise to log-weights and taking the largest is that sample. Of equal draws the smaller ids are taken,
    null ids last; of rows that are equal in both, as many as are missing, by a number that each row gets when the draws
    are stored. So the sample has exactly the asked size, whatever repeats, and nothing is sorted or joined for it. Ids
    are whole numbers; those that are the same as doubles (beyond 2**53) count as equal here.
    Every row gives one row; an empty table gives none.
    """
    numbered = weighed(docs, fit(docs, labels), seed, sharpness).withColumn("row", F.monotonically_increasing_id())
    rows = keep(numbered, "draws")
    k = math.ceil(rows.count() * (target_share(labels) if share is None else share))
    by_id = F.coalesce(-F.col("doc_id").cast("double"), F.lit(-sys.float_info.max))
    kept, tied = F.lit(False), F.lit(True)
    for key in (F.col("draw"), by_id, -F.col("row").cast("double")):
        value, k = largest(rows.where(tied).select(key.alias("draw")), k)
        # every key decides among the rows that the keys before it leave equal
        kept, tied = kept | (tied & (key > F.lit(value))), tied & (key == F.lit(value))
        if not k:
            break
    else:
        kept = kept | tied  # the last key has no equal values
    return rows.select("doc_id", "log_weight", "draw", kept.alias("kept"))
