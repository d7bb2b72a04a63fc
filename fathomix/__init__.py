"""Content-based search and corpus analytics on Spark DataFrames."""
