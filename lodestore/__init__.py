"""A memory and retrieval engine on Spark DataFrames."""
