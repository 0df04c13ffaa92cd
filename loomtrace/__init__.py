"""Session-history analytics and retrieval on Spark DataFrames."""
