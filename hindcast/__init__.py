"""Point-in-time analysis of event data on Spark DataFrames."""
