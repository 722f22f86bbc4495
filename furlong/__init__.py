"""Point-in-time race analytics on Spark DataFrames."""
