"""Market time-series analytics as Spark DataFrame, SQL and Structured Streaming operators."""
