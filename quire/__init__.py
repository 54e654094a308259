"""Question-bank analytics on Spark DataFrames."""
