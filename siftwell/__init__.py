"""A full-text search and retrieval engine on Spark DataFrames."""
