"""Fleet configuration and telemetry analytics on Spark DataFrames."""
