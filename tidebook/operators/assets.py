"""Token metadata: matching denominations to assets and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import bridged_hash, denom_exponent, path_channel, path_port, unit_price


def remap_tokens(df: DataFrame, mapping: DataFrame, column: str = "token") -> DataFrame:
    """Replace development denominations by real ones; ``mapping`` has ``denom, real_denom``."""
    named = mapping.select(F.col("denom").alias(column), "real_denom")
    return (
        df.join(named, column, "left")
        .withColumn("_real", F.coalesce("real_denom", column))
        .drop("real_denom", column)
        .withColumnRenamed("_real", column)
    )


def first_listed(assets: DataFrame) -> DataFrame:
    """One asset per base: the one of the first list (lowest ``priority``)."""
    values = [c for c in assets.columns if c not in ("base", "priority")]
    return (
        assets.groupBy("base")
        .agg(F.min_by(F.struct(*values), "priority").alias("_asset"))
        .select("base", *[F.col(f"_asset.{c}").alias(c) for c in values])
    )


def asset_match(tokens: DataFrame, assets: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Asset whose base equals the (remapped) token; the first list wins. Tokens without an asset are dropped."""
    asked = tokens.select("token", F.col("token").alias("base"))
    if mapping is not None:
        asked = remap_tokens(asked, mapping, "base")
    return asked.join(first_listed(assets), "base")


def ibc_asset_match(tokens: DataFrame, traces: DataFrame, chains: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset of bridged tokens.

    ``traces``: ``hash, path, base_denom`` of a bridged denomination; ``chains``: ``path, chain_name`` at the other
    end; ``assets``: asset rows with ``base, dst_channel, traces, priority``. An asset matches by base, channel and
    one trace element that names the same port, channel, chain and base.
    """
    asked = (
        tokens.select("token", bridged_hash(F.col("token")).alias("hash"))
        .where(F.col("hash").isNotNull())
        .join(traces, "hash")
        .join(chains, "path")
        .select(
            "token",
            "chain_name",
            F.col("base_denom").alias("base"),
            path_port(F.col("path")).alias("port"),
            path_channel(F.col("path")).alias("dst_channel"),
        )
    )
    same_trace = F.exists(
        "traces",
        lambda t: (t["type"] == "ibc")
        & (t["chain"]["port"] == F.col("port"))
        & (t["chain"]["channel_id"] == F.col("dst_channel"))
        & (t["counterparty"]["chain_name"] == F.col("chain_name"))
        & (t["counterparty"]["base_denom"] == F.col("base")),
    )
    matched = asked.join(assets, ["base", "dst_channel"]).where(same_trace)
    values = [c for c in matched.columns if c not in ("token", "priority", "traces", "chain_name", "port")]
    return (
        matched.groupBy("token")
        .agg(F.min_by(F.struct(*values), "priority").alias("_asset"))
        .select("token", *[F.col(f"_asset.{c}").alias(c) for c in values])
    )


def unit_prices(assets: DataFrame, prices: DataFrame) -> DataFrame:
    """Price of one base unit of each asset: ``token, unit_price``; 0 when there is no price."""
    joined = assets.join(prices.select("price_id", "usd"), "price_id", "left")
    return joined.select(
        F.col("token"),
        unit_price(
            denom_exponent(F.col("denom_units"), F.col("token")),
            denom_exponent(F.col("denom_units"), F.col("display")),
            F.col("usd"),
        ).alias("unit_price"),
    )
