"""Text-quality analytics on Spark DataFrames."""
