"""The corpus pipeline: quality rules, line dedup, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import line_dedup, minhash, packing, personal_data, quality_rules
from tidebook.llm.common import keep, table
from tidebook.llm.queries import BYTE_VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; one that consists of such lines only goes."""
    cleaned = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").isNull() | F.col("text").rlike(r"[^ \t-\r]")
    return cleaned.where(left).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose sets of five-word runs are similar by 0.8 or more: the one with the smallest id.

    Every row is a document of its own here, also one that repeats an id or has none. Of rows with the same id, or all
    without one, the one with the smallest hash of all columns stays; a row without words is no copy of another.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = keep(docs.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered-rows")
    found = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"), words=5, percent=80)
    order = F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", F.xxhash64("doc"), "row")
    groups = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", order.alias("order")), "row")
    groups = keep(groups, "row-groups")
    first = groups.groupBy("component_id").agg(F.min("order").alias("first"))
    gone = groups.join(first, "component_id").where(F.col("row") != F.col("first.row")).select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return personal_data.masked(docs, personal_data.fit(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the sequences."""
    return packing.pack_digest(docs, BYTE_VOCABULARY)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("personal data", personal),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
