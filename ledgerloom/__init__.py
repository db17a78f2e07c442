"""Change logs as queryable tables on Spark: sources, transactions, versions, freshness, metrics."""
