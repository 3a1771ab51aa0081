"""Behavioural comparison of labeled transition systems on Spark DataFrames."""
