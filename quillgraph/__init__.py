"""Graph embedding and community detection on Spark DataFrames."""
