"""Analytics on PySpark DataFrames, SQL and Structured Streaming."""
