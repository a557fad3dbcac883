"""tlake: a telemetry lake on Spark DataFrames and Structured Streaming."""
