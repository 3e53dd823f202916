"""Tidewright: measurement-stream analytics on Spark DataFrames, SQL and Structured Streaming."""
