"""Multi-source record intelligence on Spark DataFrames."""
