"""Token prices and token metadata as versioned or prioritised dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.assets import first_listed


def read_token_prices(versions: DataFrame) -> DataFrame:
    """Last known price per id; a refresh without a price keeps the one before."""
    given = F.when(F.col("usd").isNotNull(), F.col("last_updated_at"))
    return (
        versions.groupBy("price_id")
        .agg(F.max_by("usd", given).alias("usd"), F.max(given).alias("last_updated_at"))
        .where(F.col("usd").isNotNull())
    )


def read_assets(dynamic: DataFrame, static: DataFrame) -> DataFrame:
    """One asset per base: the dynamic list first, the static list as fallback."""
    both = dynamic.withColumn("priority", F.lit(0)).unionByName(static.withColumn("priority", F.lit(1)))
    return first_listed(both)
