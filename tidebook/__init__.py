"""Market event analytics on Spark: log decoding, order-book state, series, liquidity and change feeds."""
