"""Transaction-risk analytics on Spark: clean, split, rebalance, train, score, band, summarise."""
