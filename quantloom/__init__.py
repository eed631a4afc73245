"""Point-in-time market research analytics on Spark DataFrames."""
