"""Vector analytics and retrieval on Spark DataFrames."""
