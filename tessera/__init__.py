"""Keyed, time-series, grid and tree analytics on Spark DataFrames."""
