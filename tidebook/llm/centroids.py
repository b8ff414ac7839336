"""Clusters of integer vectors around centroids, with column expressions only: no Python code sees a vector.

A vector is usable when it has exactly ``DIMENSIONS`` components, none null or non-finite; others are left out. Component
``x`` becomes the integer ``floor(SCALE * x)``, so that sums and distances are exact and the result does not depend on the
order of rows or partitions. Rows that repeat an id or a whole row are vectors of their own; a null id takes part but never
starts a centroid. Fewer usable vectors than centroids give fewer centroids, none give an empty result;
if no usable vector has an id there is no centroid, and all columns but the id are null. Components beyond
2**21 in size have no exact distance in 64 bits: they end the job with an overflow error instead of a wrong result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import keep

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
#: Components up to this size: 64 products of two stay below 2**53, up to which doubles hold every whole number.
SMALL = 1 << 20


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v, norm, small``: the usable vectors as whole numbers, their squared lengths, and whether all components
    are so small that distances are exact in doubles. ``v`` itself is an array of doubles, which hold its numbers exactly."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    usable = vectors.where((F.size(x) == dimensions) & ~bad).select("vec_id", whole.alias("v"))
    norm = F.aggregate(_long("v"), F.lit(0).cast("long"), lambda s, c: s + c * c)
    return usable.select("vec_id", "v", norm.alias("norm"), F.forall("v", lambda c: F.abs(c) <= SMALL).alias("small"))


def _long(column: str) -> Column:
    return F.col(column).cast("array<long>")


def starting_centroids(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in that order; equal ids are ordered by vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.where(F.col("vec_id").isNotNull()).select(order.alias("h"), "v").orderBy("h", "v").limit(k)
    return [[int(c) for c in row["v"]] for row in first.collect()]  # k rows


def _literal(values: list[int], of: str) -> Column:
    """One literal array from text: a column per number would cost the driver more than the tasks need."""
    return F.expr(f"array({','.join(str(c) + {'long': 'L', 'double': 'D'}[of] for c in values)})")


def _nearest(vector: Column, centroids: list[list[int]], of: str) -> Column:
    """``distance, cluster`` of the nearest centroid, counted in one number type.

    The square of a difference is taken apart into squares and a product, so one multiplication per component is left;
    the centroids and their squares are literals of the plan.
    """
    near = []
    for number, centroid in enumerate(centroids):
        products = F.zip_with(vector, _literal([-2 * c for c in centroid], of), lambda a, b: a * b)
        square = F.lit(sum(c * c for c in centroid)).cast(of)
        distance = F.col("norm") + F.aggregate(products, square, lambda s, c: s + c).cast("long")
        near.append(F.struct(distance.alias("distance"), F.lit(number).alias("cluster")))
    return F.array_min(F.array(*near))


def assigned(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``points`` with ``cluster, distance``: the nearest centroid, the one with the smaller number of equal ones.

    Distances are whole numbers. Where all components are small they are counted in doubles, which are exact there and
    take half the time, else in 64-bit integers; the rows of either kind get what the other would give them.
    """
    nearest = _nearest(_long("v"), centroids, "long")
    if all(abs(c) <= SMALL for centroid in centroids for c in centroid):
        nearest = F.when(F.col("small"), _nearest(F.col("v"), centroids, "double")).otherwise(nearest)
    nearest = points.withColumn("__nearest", nearest)
    return nearest.select(*points.columns, "__nearest.cluster", "__nearest.distance")


def moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the floor of the mean of each cluster's vectors; an empty cluster keeps its centroid.

    Sums per cluster and component are partial sums in every task; one row per cluster comes back.
    """
    size = len(centroids[0])
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(size)]
    found = list(centroids)
    for row in assigned(points, centroids).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        found[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return found


def clustered(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, v, norm, small, cluster, distance`` of every usable vector, and the final centroids.

    Only centroids are ever on the driver: ``k * dimensions`` integers.
    """
    points = keep(quantised(vectors, dimensions, scale), "integer-vectors")
    centroids = starting_centroids(points, k, seed)
    if not centroids:
        return points.selectExpr("*", "cast(null as int) AS cluster", "cast(null as long) AS distance"), centroids
    for _ in range(rounds):
        centroids = moved(points, centroids)
    return assigned(points, centroids), centroids


def digest(vectors: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector."""
    found, centroids = clustered(vectors)
    rows = keep(found.select("vec_id", "cluster", "distance"), "assigned")
    inertia = dict.fromkeys(range(len(centroids)), 0)
    if centroids:
        inertia.update((r["cluster"], r["s"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect())
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of([inertia[n] for n in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values()) if centroids else None).cast("long").alias("inertia"),
        of(shas, "string").alias("centroid_sha256"),
    )
