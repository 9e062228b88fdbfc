"""Tidemark: point-in-time features, screening statistics and corpus preparation on Spark DataFrames."""
