"""Point-in-time panel analytics on Spark DataFrames."""
