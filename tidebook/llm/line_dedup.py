"""Removal of lines that many sites share, by distinct-site sketches per line; JVM operators only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import keep

MIN_SITES = 10
SKETCH_LOG_SIZE = 12
#: Half width of the band around the threshold in which exact counts decide, in standard errors of the sketch.
BAND_ERRORS = 6


def line_key(line: Column) -> Column:
    """128 bits of the line without the blanks around it."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b"))


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """128 bits of a row's id and whole text: rows that agree in both lose the same lines."""
    return [
        F.xxhash64(F.lit(0), F.isnull(doc_id), doc_id, text).alias("row_a"),
        F.xxhash64(F.lit(1), text, F.isnull(doc_id), doc_id).alias("row_b"),
    ]


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """``doc_id, row_a, row_b, site, place, a, b``: one row per line that holds more than blanks, with its place in the
    text; a null site counts as the site ''."""
    rows = docs.where(F.col("text").isNotNull()).select(
        "doc_id",
        *row_key(),
        F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"),
        F.split("text", "\n").alias("split"),
    )
    lines = rows.select("doc_id", "row_a", "row_b", "site", F.posexplode("split").alias("place", "line"))
    lines = lines.where(F.btrim("line", F.lit(" \t\r")) != "")
    return lines.select("doc_id", "row_a", "row_b", "site", "place", line_key(F.col("line")).alias("k")).select(
        "doc_id", "row_a", "row_b", "site", "place", "k.a", "k.b"
    )


def widespread_lines(lines: DataFrame, min_sites: int = MIN_SITES, log_size: int = SKETCH_LOG_SIZE) -> DataFrame:
    """``a, b, keeper``: lines of at least ``min_sites`` distinct sites, and the smallest document that has each.

    A line needs ``min_sites`` occurrences to have as many sites, so only such lines get a sketch. Sketches are built
    before the shuffle and merged after it: a line on all pages of the web sends one sketch per task. Lines whose
    estimate is within six standard errors of the threshold are counted exactly.
    """
    frequent = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("a", "b")
    frequent = keep(frequent, "frequent-lines")
    often = lines.join(frequent, ["a", "b"], "left_semi")
    spread = often.groupBy("a", "b").agg(
        F.hll_sketch_agg("site", F.lit(log_size)).alias("sketch"), F.min("doc_id").alias("keeper")
    )
    spread = keep(spread.select("a", "b", "keeper", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    band = BAND_ERRORS * 1.04 / 2 ** (log_size / 2) * min_sites + 0.5
    clear = spread.where(F.col("sites") > min_sites + band)
    near = spread.where(F.abs(F.col("sites") - min_sites) <= band)
    exact = (
        lines.join(near.select("a", "b"), ["a", "b"], "left_semi")
        .groupBy("a", "b", "site").agg(F.min("doc_id").alias("first"))
        .groupBy("a", "b").agg(F.count("*").alias("n"), F.min("first").alias("keeper"))
        .where(F.col("n") >= min_sites)
    )
    return clear.select("a", "b", "keeper").unionByName(exact.select("a", "b", "keeper"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Documents without the lines that ``min_sites`` or more distinct sites have; adds ``n_lines, n_removed``.

    A line is what stands between ``\\n``; blanks around it don't count and blank lines always stay. The document with
    the smallest ``doc_id`` that has a widespread line keeps it, so that a text copied to many sites survives once.
    Null texts stay null with no lines; rows that repeat a ``doc_id`` are the same document; a null ``doc_id`` is a
    document of its own kind that keeps a line only if no other has it. An empty table gives an empty result.
    """
    lines = site_lines(docs, site)
    spread = keep(widespread_lines(lines, min_sites), "widespread-lines")
    hits = lines.join(spread, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # a group is the removed places of one text, also where many rows have no id
    per_row = hits.groupBy("row_a", "row_b").agg(F.collect_set("place").alias("gone"))
    whole = docs.select(*row_key(), F.struct("*").alias("row"))
    text = F.col("row.text")
    # the one-element explode makes the lines a column: an expression would be split again for every line below
    found = whole.join(per_row, ["row_a", "row_b"], "left").select(
        "row", "gone", F.explode(F.array(F.split(text, "\n"))).alias("split")
    )
    places = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")
    left = F.transform(places, lambda i: F.get("split", i))
    result = found.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("new"),
        F.coalesce(F.size("split"), F.lit(0)).alias("lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("removed"),
    )
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "n_chars", "n_lines", "n_removed")]
    chars = [F.length("new").cast("long").alias("n_chars")] if "n_chars" in docs.columns else []
    return result.select(
        *kept, F.col("new").alias("text"), *chars, F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed")
    )
